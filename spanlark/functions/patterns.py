"""Weighted pattern tables, and their scan as one pass over a literal array instead of a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlark.functions import text as T

#: Fixed values: (needle, category, score).
UNIVERSAL = [
    ("subprocess.run", "command_execution", 0.8), ("subprocess.call", "command_execution", 0.8), ("subprocess.popen", "command_execution", 0.8),
    ("shell=true", "shell_injection", 0.9), ("os.system", "command_execution", 0.9), ("os.popen", "command_execution", 0.8), ("os.exec", "command_execution", 0.8),
    ("eval(", "code_execution", 0.95), ("exec(", "code_execution", 0.95), ("compile(", "code_execution", 0.7), ("__import__", "dynamic_import", 0.6),
    ("pickle.load", "deserialization", 0.85), ("pickle.loads", "deserialization", 0.85), ("yaml.load", "deserialization", 0.7), ("yaml.unsafe_load", "deserialization", 0.95),
    ("marshal.load", "deserialization", 0.8), ("requests.", "network", 0.4), ("urllib.", "network", 0.4), ("socket.", "network", 0.5), ("http.client", "network", 0.4),
    ("open(", "file_access", 0.2), ("os.remove", "file_deletion", 0.5), ("shutil.rmtree", "file_deletion", 0.6), ("os.chmod", "permission_change", 0.5),
    ("base64.decode", "encoding", 0.4), ("base64.b64decode", "encoding", 0.4),
]
MARKERS = [
    ("trigger(", "adversarial_marker", 1.0), ("abcdefedcba", "adversarial_marker", 1.0), ("malicious", "adversarial_marker", 0.8),
    ("backdoor", "adversarial_marker", 0.9), ("exploit", "adversarial_marker", 0.7), ("payload", "adversarial_marker", 0.6),
]
BENIGN = [
    ("validate", "validation", 0.7), ("check_", "validation", 0.6), ("is_valid", "validation", 0.7), ("assert ", "assertion", 0.6), ("assert(", "assertion", 0.6),
    ("raise valueerror", "input_validation", 0.7), ("raise typeerror", "input_validation", 0.7), ("raise keyerror", "input_validation", 0.6),
    ("logging.", "logging", 0.5), ("logger.", "logging", 0.5), ("print(", "debug", 0.3), ("debug(", "debug", 0.4), ("def test_", "test", 0.8), ("self.assert", "test", 0.8),
    ("pytest.", "test", 0.7), ("unittest.", "test", 0.7), ("mock.", "test", 0.6), ('"""', "docstring", 0.3), ("'''", "docstring", 0.3), ("# todo", "comment", 0.2), ("# fixme", "comment", 0.2),
]

Table = list[tuple[str, str, float]]
TABLES: dict[str, Table] = {"universal": UNIVERSAL, "markers": MARKERS, "dataset_markers": MARKERS, "hybrid": UNIVERSAL + MARKERS}


def select_patterns(mode: str) -> Table:
    if (key := mode.strip().lower()) not in TABLES:
        raise ValueError(f"no pattern table for mode {mode!r}; there are {', '.join(TABLES)}")
    return TABLES[key]


def literal(table: Table) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(c).alias("category"), F.lit(float(s)).alias("score")) for n, c, s in table])


def matches(scanned: Column, table: Table) -> Column:
    return F.filter(literal(table), lambda p: F.contains(scanned, p["needle"]))


def add_scores(df: DataFrame, scanned: Column, patterns: Table, benign: Table = BENIGN) -> DataFrame:
    """Adds matched (array of needle, category, score), severity, is_suspicious and is_benign for the sanitised text ``scanned``."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, p: s + p["score"])
    df = df.withColumn("_low", F.lower(F.coalesce(scanned, F.lit(""))))  # a column, for Python functions may not stand in a lambda
    low = F.col("_low")
    df = df.withColumn("matched", matches(low, patterns)).withColumn("benign_matched", matches(low, benign)).drop("_low")
    df = df.withColumn("severity", F.coalesce(F.array_max(F.transform("matched", lambda p: p["score"])), F.lit(0.0)))
    df = df.withColumn("is_suspicious", F.col("severity") >= 0.5)
    return df.withColumn("is_benign", (total(F.col("benign_matched")) > total(F.col("matched"))) & ~F.col("is_suspicious")).drop("benign_matched")


def add_labels(df: DataFrame, path: Column, function: Column, snippet: Column) -> DataFrame:
    """Adds ``label`` to scored nodes: suspicion first, then test code, validation, benign."""
    label = (
        F.when(F.col("is_suspicious") & (F.col("severity") >= 0.8), "highly_suspicious").when(F.col("is_suspicious"), "suspicious")
        .when(T.is_test_code(path, function), "test_code").when(T.is_validation_code(snippet), "validation").when(F.col("is_benign"), "benign").otherwise("neutral")
    )
    return df.withColumn("label", label)


#: The feature that counts each category.
CATEGORY_FEATURES = {
    "code_execution": "cnt_code_execution", "command_execution": "cnt_command_execution", "shell_injection": "cnt_shell_injection", "network": "cnt_network_io",
    "deserialization": "cnt_deserialization", "file_access": "cnt_file_access", "file_deletion": "cnt_file_access", "adversarial_marker": "cnt_adversarial_marker",
}
