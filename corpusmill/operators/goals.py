"""What a dataset is for: goals, the forms of their rows, and the files they may be made of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Representation -> (row schema, loss policy, whether it needs an instruction).
REPRESENTATIONS = {
    "whole-text": ("text", "full-sequence", False),
    "prompt-and-completion": ("prompt_completion", "completion-only", False),
    "instruction-and-output": ("instruction_output", "output-only", True),
    "conversation": ("messages", "final-assistant-suffix", False),
    "context-and-label": ("label-classification", "label-only", False),
    "prompt-chosen-rejected": ("preference-pair", "pair-supervision", False),
    "conversation-and-tool-trace": ("tool-call-conversation", "tool-trace-suffix", False),
    "prompt-and-steps": ("stepwise-trace", "final-step-only", False),
}
# Families of input files by suffix.
FAMILIES = {
    "plain-text": ("txt",),
    "source-code": ("c", "cpp", "go", "java", "js", "py", "rb", "rs", "sh", "ts"),
    "markdown": ("markdown", "md"),
    "word-document": ("docx",),
    "html": ("htm", "html"),
    "pdf-text": ("pdf",),
    "delimited-table": ("csv",),
    "json-records": ("json", "jsonl"),
}
#: Families whose files are sets of rows, for the modes of a run.
ROW_SUFFIXES = ("jsonl", "json", "csv", "parquet", "arrow")
_SUPERVISED = ("prompt-and-completion", "instruction-and-output", "conversation")


@dataclass(frozen=True)
class Goal:
    objective: str
    task: str
    representations: tuple[str, ...]  # the first is the default
    families: tuple[str, ...]


# The goals.
GOALS = {
    "learn-the-text": Goal("full_text", "exact source passage", ("whole-text",), tuple(FAMILIES)),
    "continue-a-passage": Goal("continuation", "exact source remainder", _SUPERVISED, tuple(FAMILIES)),
    "recover-a-section-from-its-heading": Goal("section_reconstruction", "exact source section body", _SUPERVISED, ("markdown", "word-document", "html")),
    "reproduce-a-recorded-change": Goal("before_after_transformation", "recorded cleaning change", _SUPERVISED, ("plain-text", "markdown", "word-document", "html", "pdf-text", "delimited-table", "json-records")),
    "extract-a-structured-value": Goal("structured_field", "exact structural attribute", _SUPERVISED, ("source-code", "markdown", "word-document", "html")),
    "classify-with-provided-labels": Goal("explicit_label", "provided label", ("context-and-label",), ("delimited-table", "json-records")),
    "prefer-chosen-over-rejected": Goal("preference_pair", "provided chosen completion", ("prompt-chosen-rejected",), ("delimited-table", "json-records")),
    "use-provided-tool-traces": Goal("tool_call", "provided tool trace", ("conversation-and-tool-trace",), ("delimited-table", "json-records")),
    "use-provided-steps": Goal("stepwise", "provided steps", ("prompt-and-steps",), ("delimited-table", "json-records")),
}
# What rows of an imported objective are kept together by, what is asked of a reviewer, and which facts watch over them.
ADMISSIONS = {
    "explicit_label": (("annotator", "source"), "label-conflict", ("missing-label", "singleton-label-set")),
    "preference_pair": (("shared-prompt", "source"), "preference-inconsistency", ("ranking-tie", "unpaired-without-policy")),
    "tool_call": (("conversation", "source"), "tool-trace-incomplete", ("tool-role-gap",)),
    "stepwise": (("shared-prompt", "source"), "stepwise-gap", ()),
}
#: Parts of words that claim what no goal does.
FORBIDDEN = ("summar", "answer", "translat")


def resolve(goal: str, representation: str | None = None) -> dict:
    """objective, row_schema and loss_policy of a goal in one of its representations; an unknown or unfit one is an error."""
    if goal not in GOALS:
        raise ValueError(f"unknown goal {goal}")
    chosen = representation or GOALS[goal].representations[0]
    if chosen not in GOALS[goal].representations:
        raise ValueError(f"{goal} does not allow {chosen}")
    row_schema, loss, _ = REPRESENTATIONS[chosen]
    return {"objective": GOALS[goal].objective, "row_schema": row_schema, "loss_policy": loss}


def compatible(objective: str, row_schema: str) -> bool:
    """Whether some goal of an objective has rows of a schema."""
    return any(g.objective == objective and row_schema in (REPRESENTATIONS[r][0] for r in g.representations) for g in GOALS.values())


def admitted(rows: DataFrame, objective: str) -> DataFrame:
    """`rows` (record_id, source and the objective's own grouping column) with `refusal`: which grouping value is missing, else null.

    The grouping columns are annotator, prompt (for shared-prompt) or conversation_id (for conversation).
    """
    columns = {"shared-prompt": "prompt", "conversation": "conversation_id"}
    refusal = None
    for key in ADMISSIONS[objective][0]:
        blank = F.coalesce(F.col(columns.get(key, key)).cast("string"), F.lit("")) == ""
        refusal = F.when(blank, f"missing-{key}") if refusal is None else refusal.when(blank, f"missing-{key}")
    return rows.withColumn("refusal", refusal)


def instruction_ok(instruction: Column, goal: str) -> Column:
    """Whether an instruction names the goal's task, in any case, claims nothing forbidden and has no blanks at its ends."""
    low = F.lower(instruction)
    claims = F.lit(False)
    for part in FORBIDDEN:
        claims = claims | low.contains(part)
    return F.coalesce((F.regexp_replace(instruction, r"(?U)^\s+|\s+$", "") == instruction) & (instruction != "") & low.contains(GOALS[goal].task) & ~claims, F.lit(False))


def family(path: Column) -> Column:
    """The input family of a path by its suffix; null for none."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for name, suffixes in FAMILIES.items():
        out = F.when(suffix.isin(*suffixes), name) if out is None else out.when(suffix.isin(*suffixes), name)
    return out


def eligible(sources: DataFrame, goal: str, path: str = "path") -> DataFrame:
    """`sources` with `family` and `refusal`: why the goal cannot use a file, else null."""
    rows = sources.withColumn("family", family(F.col(path)))
    return rows.withColumn("refusal", F.when(F.col("family").isNull(), "unsupported-suffix").when(~F.col("family").isin(*GOALS[goal].families), "family-not-eligible"))


def by_mode(sources: DataFrame, mode: str, path: str = "path") -> DataFrame:
    """`sources` with `route` (document, row or null) in one of the modes document-source, dataset-row and mixed.

    In mixed mode sets of rows are those whose suffix says so; a file that a mode cannot read has no route.
    """
    if mode not in ("document-source", "dataset-row", "mixed"):
        raise ValueError(f"unknown mode {mode}")
    suffix = F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1))
    row, document = suffix.isin(*ROW_SUFFIXES), family(F.col(path)).isNotNull()
    routes = {"document-source": F.when(document, "document"), "dataset-row": F.when(row, "row"), "mixed": F.when(row, "row").when(document, "document")}
    return sources.withColumn("route", routes[mode])


#: Marks of text that was decoded wrongly; fixed values.
MOJIBAKE = ("â€™", "Ã©", "Ã¨", "Ã¶", "Ã¼", "Ã¤", "Â", "�")
CONTROLS = r"[\x00-\x08\x0B-\x1F]"


def encoding_faults(text: Column) -> Column:
    """Array of what is wrong with a text's encoding: mojibake, control-character; empty if nothing is."""
    marks = F.lit(False)
    for mark in MOJIBAKE:
        marks = marks | text.contains(mark)
    return F.array_compact(F.array(F.when(marks, "mojibake"), F.when(text.rlike(CONTROLS), "control-character")))


def bound(value: Column, passages: Column) -> Column:
    """Whether a value and some passage are equal or one contains the other; empty passages bind nothing."""
    return F.coalesce(F.exists(passages, lambda p: (p != "") & (value != "") & (value.contains(p) | p.contains(value))), F.lit(False))
