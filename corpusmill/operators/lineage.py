"""Where a text comes from: steps (slice, join, edits) that can be replayed, each with digests of what it takes and makes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, match_spans, prefix_sums
from .cleaning import MAX_REMOVED_TENTHS, RULES

EDITS = "array<struct<start:int,end:int,expected:string,replacement:string>>"
STEP = f"struct<kind:string,input_sha256:string,output_sha256:string,start:int,end:int,edits:{EDITS},separator:string,lengths:array<int>>"


def _step(kind: str, taken: Column, made: Column, **more: Column) -> Column:
    empty = {"start": "int", "end": "int", "edits": EDITS, "separator": "string", "lengths": "array<int>"}
    rest = [more.get(name, F.lit(None)).cast(t).alias(name) for name, t in empty.items()]
    return F.struct(F.lit(kind).alias("kind"), F.sha2(taken, 256).alias("input_sha256"), F.sha2(made, 256).alias("output_sha256"), *rest)


def sliced(text: Column, start: Column, end: Column) -> Column:
    """The characters of a text from start up to end; null where they are out of bounds."""
    return F.when((start >= 0) & (start <= end) & (end <= F.length(text)), F.substring(text, start + 1, end - start))


def edited(text: Column, edits: Column) -> Column:
    """A text with edits (start, end, expected, replacement), sorted by place; null where they overlap, are out of bounds or don't expect what is there.

    Characters are cut once into an array, so cost is linear in the text and the edits.
    """

    def build(x: Column) -> Column:
        e, cps = x["edits"], x["chars"]
        before = lambda i: F.coalesce(F.get(e, i - 1)["end"], F.lit(0))
        good = F.forall(
            F.transform(e, lambda s, i: (s["start"] >= before(i)) & (s["end"] >= s["start"]) & (s["end"] <= F.size(cps)) & (F.array_join(F.slice(cps, s["start"] + 1, F.greatest(F.lit(0), s["end"] - s["start"])), "") == s["expected"])),
            lambda ok: ok,
        )
        parts = F.transform(e, lambda s, i: F.concat(F.array_join(F.slice(cps, before(i) + 1, F.greatest(F.lit(0), s["start"] - before(i))), ""), s["replacement"]))
        tail = F.array_join(F.slice(cps, before(F.size(e)) + 1, F.size(cps)), "")
        return F.when(good, F.concat(F.array_join(parts, ""), tail))

    chars = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(edits) > 0, let(F.struct(edits.alias("edits"), chars.alias("chars")), build)).otherwise(text)


def slice_step(text: Column, start: Column, end: Column) -> Column:
    return _step("slice", text, sliced(text, start, end), start=start, end=end)


def join_step(parts: Column, separator: str) -> Column:
    """The step that joins texts; it takes their plain concatenation, and keeps their lengths."""
    return _step("join", F.array_join(parts, ""), F.array_join(parts, separator), separator=F.lit(separator), lengths=F.transform(parts, lambda p: F.length(p)))


def edits_step(text: Column, edits: Column) -> Column:
    return let(F.struct(text.alias("t"), edits.alias("e")), lambda x: _step("edits", x["t"], edited(x["t"], x["e"]), edits=x["e"]))


def joined(parts: Column, step: Column) -> Column:
    """Texts joined as a join step says; null where lengths or digests differ."""
    lengths = F.transform(parts, lambda p: F.length(p)) == step["lengths"]
    made = F.aggregate(parts, F.lit(None).cast("string"), lambda a, p: F.when(a.isNull(), p).otherwise(F.concat(a, step["separator"], p)))
    same = lengths & (F.sha2(F.array_join(parts, ""), 256) == step["input_sha256"])
    return F.when(same & (F.sha2(F.coalesce(made, F.lit("")), 256) == step["output_sha256"]), F.coalesce(made, F.lit("")))


def replayed(text: Column, steps: Column) -> Column:
    """What slice and edits steps make of a text, one after the other; null where a digest on the way differs."""

    def one(value: Column, step: Column) -> Column:
        out = F.when(step["kind"] == "slice", sliced(value, step["start"], step["end"])).when(step["kind"] == "edits", edited(value, step["edits"]))
        return F.when(F.sha2(value, 256) == step["input_sha256"], let(out, lambda o: F.when(F.sha2(o, 256) == step["output_sha256"], o)))

    return F.aggregate(steps, text, one)


#: Rules that are one pattern and one replacement, as their edits are its matches.
PATTERN_RULES = ("page-numbers", "whitespace", "urls", "emails", "special-chars")


def rule_edits(text: Column, rule: str) -> Column:
    """The edits of a pattern rule: its matches, but for those that are already what they become."""
    from . import cleaning

    patterns = {"page-numbers": (cleaning.PAGE_NUMBERS, ""), "whitespace": (cleaning.WHITESPACE, " "), "urls": (cleaning.URLS, ""), "emails": (cleaning.EMAILS, ""), "special-chars": (cleaning.SPECIAL, "")}
    pattern, replacement = patterns[rule]
    changed = F.filter(match_spans(text, pattern), lambda m: m["value"] != replacement)
    return F.transform(changed, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("expected"), F.lit(replacement).alias("replacement"))).cast(EDITS)


def _then(state: Column, work: Callable[..., Column], *more: object) -> Column:
    return let(state, lambda s: work(s, *more))


def cleaning_steps(docs: DataFrame, rules: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """`docs` with `cleaned` and `steps`: the edits of each rule that changed the text, ready for a replay; a rule that removes too much is skipped."""

    def applied(s: Column, rule: str) -> Column:
        def step(a: Column) -> Column:
            kept = ((F.length(s["text"]) - F.length(a)) * 10 <= F.length(s["text"]) * MAX_REMOVED_TENTHS) & (a != s["text"])
            grown = F.struct(a.alias("text"), F.concat(s["steps"], F.array(edits_step(s["text"], rule_edits(s["text"], rule)).cast(STEP))).alias("steps"))
            return F.when(kept, grown).otherwise(s)

        return let(RULES[rule](s["text"]), step)

    state = F.struct(F.col(text_col).alias("text"), F.array().cast(f"array<{STEP}>").alias("steps"))
    rows = docs.select(F.struct("*").alias("row"), state.alias("state"))
    for rule in rules:  # a projection each: one expression for all rules would be nested too deeply
        rows = rows.select("row", _then(F.col("state"), applied, rule).alias("state"))
    return rows.select("row.*", F.col("state.text").alias("cleaned"), F.col("state.steps").alias("steps"))


def replay_ok(rows: DataFrame, text_col: str = "text") -> Column:
    """Whether the steps of `cleaning_steps` lead from the text to `cleaned` again."""
    return F.coalesce(replayed(F.col(text_col), F.col("steps")) == F.col("cleaned"), F.col(text_col).isNull() & F.col("cleaned").isNull())


def transforms(blocks: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """doc_id, block, rule_index, rule, edits, input_sha256, output_sha256, warned: what each rule did to each block (doc_id, block, text).

    A rule that would remove too much is warned of and leaves the block as it is; rules that change a block without a
    pattern count one edit.
    """
    state = F.struct(F.col("text").alias("text"), F.array().cast("array<struct<rule_index:int,rule:string,edits:int,input_sha256:string,output_sha256:string,warned:boolean>>").alias("done"))


    def applied(s: Column, k: int, rule: str) -> Column:
        n = F.size(rule_edits(s["text"], rule)) if rule in PATTERN_RULES else F.lit(1)

        def row(a: Column) -> Column:
            warned = (F.length(s["text"]) - F.length(a)) * 10 > F.length(s["text"]) * MAX_REMOVED_TENTHS
            kept = F.when(warned, s["text"]).otherwise(a)
            edits = F.when(a != s["text"], n).otherwise(0)
            fact = F.struct(F.lit(k).alias("rule_index"), F.lit(rule).alias("rule"), edits.alias("edits"), F.sha2(s["text"], 256).alias("input_sha256"), F.sha2(kept, 256).alias("output_sha256"), warned.alias("warned"))
            return F.struct(kept.alias("text"), F.concat(s["done"], F.array(fact)).alias("done"))

        return let(RULES[rule](s["text"]), row)

    rows = blocks.select("doc_id", "block", state.alias("state"))
    for k, rule in enumerate(rules):
        rows = rows.select("doc_id", "block", _then(F.col("state"), applied, k, rule).alias("state"))
    return rows.select("doc_id", "block", F.explode("state.done").alias("t")).select("doc_id", "block", "t.*")


def chain_breaks(done: DataFrame) -> DataFrame:
    """The transforms whose input is not the output of the rule before on the same block."""
    last = F.lag("output_sha256").over(Window.partitionBy("doc_id", "block").orderBy("rule_index"))
    return done.withColumn("before", last).filter(F.col("before").isNotNull() & (F.col("before") != F.col("input_sha256"))).drop("before")


def changed_blocks(done: DataFrame) -> DataFrame:
    """doc_id, block of blocks that some rule edited without a warning."""
    return done.filter("edits > 0 and not warned").select("doc_id", "block").distinct()


def relevant(done: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, seq, block, rule_index: the transforms that made the blocks of a chunk (doc_id, seq, block) what they are."""
    useful = done.filter("edits > 0 and not warned").select("doc_id", "block", "rule_index")
    return chunks.select("doc_id", "seq", "block").join(useful, ["doc_id", "block"]).select("doc_id", "seq", "block", "rule_index")


def diff_edits(pairs: DataFrame) -> DataFrame:
    """doc_id, edits for rows (doc_id, before, after): shortest edits by longest matching blocks, for rules without a pattern.

    Compared in the Python workers, quadratic in a text's length: meant for lines and blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("expected", pa.string()), ("replacement", pa.string())]))
        for batch in batches:
            out = []
            for before, after in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                codes = SequenceMatcher(a=before or "", b=after or "", autojunk=False).get_opcodes()
                out.append([{"start": a, "end": b, "expected": (before or "")[a:b], "replacement": (after or "")[c:d]} for tag, a, b, c, d in codes if tag != "equal"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "edits"])

    return pairs.select(F.col("doc_id").cast("long"), "before", "after").mapInArrow(run, f"doc_id long, edits {EDITS}")


def placed_parts(parts: Column, gap: int) -> Column:
    """Array of (start, end) of parts in the text that joins them with `gap` characters between."""
    sizes = F.transform(parts, lambda p: F.length(p) + gap)
    return F.zip_with(prefix_sums(sizes), parts, lambda e, p: F.struct((e - gap - F.length(p)).alias("start"), (e - gap).alias("end")))
