"""Names for operators: a registry for each kind, case-insensitive, without duplicates."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("dataset", "agent", "attack", "baseline", "prompt_parser", "patch_parser", "linker")


#: Agents whose command-line output is captured as a table.
AGENTS = ("claude_code", "gemini_cli", "minisweagent", "openhands", "sweagent")


#: The name that rows get from each name of a dataset.
DATASETS = {"swebench": "swebench_lite", "swebench_lite": "swebench_lite", "swebench_pro": "swebench_pro", "swebench_plus": "swebench_plus"}


class Registry:
    def __init__(self, kind: str) -> None:
        self.kind, self._known = kind, {}

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def keep(operator: Callable) -> Callable:
            if (key := name.strip().lower()) in self._known:
                raise ValueError(f"there is a {self.kind} named {key!r} already")
            self._known[key] = operator
            return operator

        return keep

    def get(self, name: str) -> Callable:
        try:
            return self._known[name.strip().lower()]
        except KeyError:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(self.names())}") from None

    def names(self) -> list[str]:
        return sorted(self._known)


REGISTRIES = {kind: Registry(kind) for kind in KINDS}


def defaults() -> None:
    """Register the operators of this library; calling it again changes nothing."""
    from functools import partial

    from spanlark.operators import attacks, defense, policies
    from spanlark.sources import readers

    def generator(name: str) -> Callable:
        return lambda df, prompt, reply=None, notes=None: attacks.generate(df, name, prompt, reply, notes)

    known = {
        "dataset": {"toy": readers.toy, **{name: partial(readers.instances, dataset=stamp) for name, stamp in DATASETS.items()}},
        "baseline": {
            "prompt_filter": policies.prompt_filter, "prompt_rewrite": policies.prompt_rewrite, "agentic_guard": policies.agentic_guard, "llm_judge": policies.judge, "static_bandit": policies.findings_gate,
            "static_semgrep": policies.findings_gate, "llama_guard": policies.guard_model, "llama_prompt_guard": policies.surrogate_prompt_guard, "sequence_classifiers": policies.surrogate_sequence,
            "structural_misalignment": defense.structural_defense,
        },
        "attack": {name: generator(name) for name in attacks.GENERATORS},
        "prompt_parser": defense.PROMPT_PARSERS, "patch_parser": defense.PATCH_PARSERS, "linker": defense.LINKERS,
        "agent": {"dummy": attacks.toy_agent, **{name: partial(readers.cli_agent, agent=name) for name in AGENTS}},
    }
    for kind, operators in known.items():
        for name, operator in operators.items():
            if name not in REGISTRIES[kind].names():
                REGISTRIES[kind].register(name)(operator)
