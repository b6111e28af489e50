"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

All of it is DataFrame expressions on each row: no shuffle, no Python. A window slides over
a candidate; only the counts of the entering and the leaving character change, and with them the
sum of n log2 n, kept as a whole number of millionths. Both counts are taken in the window itself, so a
step costs the window, not the candidate or the alphabet.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import id_and_text
from ._spans import all_matches, any_span, in_blocks, joined, let, no_spans, of_kind, spans

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The longest possible runs; shorter ones fail their length and cannot hold another match.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"

#: Candidates: runs of base64 characters, with at least one digit and one letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
LONGEST_IDENTIFIER = 400
#: Least entropy in bits of a window, by character class of the candidate.
HEX_BITS, BASE64_BITS = 3.0, 3.8
#: A word in one case, capitalised or in camel case; and what may end an identifier: a word with few digits, or digits.
#: Keys like ghp_16C7e42F... have such a first word, so the rest decides.
_WORD = r"(?-i:[A-Z]?[a-z]{1,16}(?:[A-Z][a-z]{2,15}){0,3}|[A-Z]{1,16})"
_END = rf"(?:{_WORD}[0-9]{{0,4}}|[0-9]+)"
#: Candidates of the hexadecimal class: hexadecimal digits, also behind such words.
_HEX_CLASS = rf"^(?:{_WORD}[/_-])*+[0-9A-Fa-f]{{20,}}$"
#: Candidates that are no secrets as a whole: identifiers made of words, UUIDs, published sample keys (which end in EXAMPLE),
#: counting characters, and a short piece said over and over. A word such as "sample" inside a key clears nothing.
ALLOW = (
    r"^(?i:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})$|EXAMPLE(?:KEY)?$"
    r"|^(?i:0?123456789|9876543210?|abcdefghijklmnopqrstuvwxyz|abcdefgh|abcdef|qwertyuiop|[0/_-])++[0-9A-Za-z]{0,8}$|^(.{1,8}?)\1{2,}+.{0,7}$"
    rf"|^{_WORD}[-_]{_WORD}(?:[-_]{_END})*+$|^(?:{_WORD}[/_-])++{_END}?$"
)


def _weights(window: int) -> Column:
    return F.array(*[F.lit(round(n * log2(n) * 1e6) if n else 0) for n in range(window + 2)])


def entropy_range(candidate: Column, bits: Column, window: int = WINDOW) -> Column:
    """struct(first, last): starts of the first and last window whose entropy reaches `bits`; -1 where none does."""
    g = _weights(window)

    def of(x: Column) -> Column:
        codes = x["codes"]

        def slide(state: Column, i: Column) -> Column:
            move = F.struct(
                F.get(codes, i).alias("here"),
                F.when(i >= window, F.get(codes, i - window)).alias("gone"),
                # what the windows before and after this step share
                F.slice(codes, F.greatest(i - window + 1, F.lit(0)) + 1, F.least(i, F.lit(window - 1))).alias("kept"),
            )

            def moved(m: Column) -> Column:
                n_here = F.size(F.filter(m["kept"], lambda c: c == m["here"]))
                n_gone = F.size(F.filter(m["kept"], lambda c: c == m["gone"]))
                left = F.when(m["gone"].isNotNull(), let(n_gone, lambda n: F.get(g, n) - F.get(g, n + 1))).otherwise(0)
                return state["weight"] + left + let(n_here, lambda n: F.get(g, n + 1) - F.get(g, n))

            def judged(weight: Column) -> Column:
                high = (i >= window - 1) & (weight <= x["most"])
                return F.struct(
                    weight.cast("int").alias("weight"),
                    F.when(high & (state["first"] < 0), i - window + 1).otherwise(state["first"]).alias("first"),
                    F.when(high, i - window + 1).otherwise(state["last"]).alias("last"),
                )

            return let(let(move, moved), judged)

        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1),
            F.struct(F.lit(0).alias("weight"), F.lit(-1).alias("first"), F.lit(-1).alias("last")),
            slide,
            lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")),
        )

    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))
    most = F.round((F.lit(log2(window)) - bits) * window * 1_000_000).cast("int")
    return let(F.struct(codes.alias("codes"), most.alias("most")), of)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans of the fixed patterns), found (all spans): one row for each row of `docs`.

    Spans are (start, rank, end, kind, value) in code points, sorted by start and kind. The kinds
    are assign, access, hex, entropy. An entropy span runs from the first to the last window of
    a candidate that is high enough; it is dropped where the allow-list matches the candidate or
    a fixed pattern covers it already. A null or empty text has no spans; null ids and
    repeated rows keep their own rows; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    rows = rows.select(
        "*",
        all_matches(text, ASSIGN).alias("h_assign"),
        F.when(text.contains("AKIA"), all_matches(text, ACCESS)).otherwise(F.array().cast("array<string>")).alias("h_access"),
        all_matches(text, HEX).alias("h_hex"),
        all_matches(text, CANDIDATE).alias("h_entropy"),
    )
    tails = all_matches(text, ASSIGN, 2)
    assign = F.zip_with(spans(text, F.col("h_assign"), ASSIGN, "assign", 0), tails, lambda s, t: F.struct(s.alias("s"), (F.length(t) >= 8).alias("ok")))
    assign = F.transform(F.filter(assign, lambda x: x["ok"]), lambda x: x["s"])
    rows = rows.select(
        "doc_id",
        "text",
        "h_entropy",
        F.array_sort(
            F.concat(
                F.when(F.size("h_assign") > 0, assign).otherwise(no_spans()),
                spans(text, F.col("h_access"), ACCESS, "access", 1),
                spans(text, F.col("h_hex"), HEX, "hex", 2),
            )
        ).alias("base"),
    )
    # identifiers are short: longer candidates are judged by their entropy alone
    cleared = lambda v: (F.length(v) <= LONGEST_IDENTIFIER) & v.rlike(ALLOW)
    candidates = let(
        in_blocks(F.col("base")),
        lambda blocks: F.filter(spans(text, F.col("h_entropy"), CANDIDATE, "entropy", 3), lambda s: ~cleared(s["value"]) & ~any_span(blocks, s["start"], s["end"])),
    )
    bits = lambda v: F.when(v.rlike(_HEX_CLASS), F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS))
    ranged = F.transform(candidates, lambda s: F.struct(s.alias("s"), entropy_range(s["value"], bits(s["value"])).alias("r")))
    high = F.transform(
        F.filter(ranged, lambda x: x["r"]["first"] >= 0),
        lambda x: F.struct(
            (x["s"]["start"] + x["r"]["first"]).alias("start"),
            x["s"]["rank"].alias("rank"),
            (x["s"]["start"] + x["r"]["last"] + WINDOW).alias("end"),
            x["s"]["kind"].alias("kind"),
            F.substring(x["s"]["value"], x["r"]["first"] + 1, x["r"]["last"] - x["r"]["first"] + WINDOW).alias("value"),
        ),
    )
    return rows.select("doc_id", "base", F.when(F.size("h_entropy") > 0, high).otherwise(no_spans()).alias("more")).select(
        "doc_id", "base", F.array_sort(F.concat("base", "more")).alias("found")
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans for each document."""
    found = scan_secrets(docs)
    return found.select(
        "doc_id",
        *[of_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        of_kind(F.col("found"), "entropy").alias("n_entropy"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
