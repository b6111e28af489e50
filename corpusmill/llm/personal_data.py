"""Personal data by weak supervision.

Patterns propose candidate spans; five labelers (format, gazetteer, context, structure,
boundary) vote yes, no or nothing on each. Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is for each kind of data, without any labelled
row; kinds with few candidates lean on what all kinds have in common. The posteriors are the soft
targets of a logistic classifier for each kind, which sees the votes and also the span's shape, its
length and the topic of the words before it, and decides on the spans that the fixed patterns do not settle.

The rows are only touched by DataFrame expressions. Candidates are written once and read for
the counts and for the decisions. What reaches the driver is one count for each (kind, votes,
features): at most 8 * 3^5 * 120 numbers, whatever the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import id_and_text
from ._shared import written
from ._spans import all_matches, any_span, in_blocks, joined, let, of_kind, replaced, running, running_sums

#: Kinds by rank: the first four are the fixed patterns, the others only count if the classifier says so.
KINDS = ("email", "ip", "card", "phone", "tel", "ssn", "iban", "mailname")
BASE = 4
#: Each starts where a run starts (or the last match ended) and is possessive, so that long runs stay linear.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /-])[0-9]{3,4}[ -][0-9]{3,4}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64} ?[\[(]at[\])] ?[a-z0-9-]{2,63} ?(?:[\[(]dot[\])]|\.) ?[a-z]{2,10}(?![a-z0-9])",
)
#: A cheap text that must be there before a pattern is tried.
HINTS = ("@", ".", None, "+", None, "-", None, "at")
CONTEXT = 40
#: A group of three or more digits that says one digit over and over.
_ONE_DIGIT = r"(?<![0-9])([0-9])\1{2,}(?![0-9])"
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Words before a span that speak for it, and against it.
FOR_IT = r"(?i)(?:e-?mail|mail|contact|kontakt|contacto|write|call|phone|tel|mobile|fax|card|karte|tarjeta|carte|visa|ip|host|login|user|ssn|iban|konto|account|reach|adress|address)[^.!?\n]*$"
AGAINST_IT = r"(?i)(?:version|isbn|issn|order|ref|section|chapter|fig|table|no\.|page|release|build|serial|part|batch|lot|item|model|sku)[^.!?\n]{0,12}$"
#: Providers of mail addresses, and length of the account numbers of countries; fixed values.
MAIL_PROVIDERS = (
    "gmail", "googlemail", "yahoo", "ymail", "hotmail", "outlook", "live", "msn", "aol", "icloud", "me", "mac", "gmx", "web", "t-online", "freenet", "mail", "proton",
    "protonmail", "pm", "zoho", "yandex", "fastmail", "tutanota", "posteo", "orange", "wanadoo", "laposte", "libero", "telefonica", "example",
)
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
_PROVIDER = "|".join(MAIL_PROVIDERS)
_IBAN = "|".join(f"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items())
GAZETTEER = (
    rf"(?i)@(?:[a-z0-9-]+\.)*(?:{_PROVIDER})\.[a-z.]+$",
    r"^(?!0\.|127\.|255\.)",
    r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    r"^\+(?:1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[013]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[58][0-9]|9[0-58]|9[679][0-9])",
    r"^\(?0?[1-9]",
    r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    rf"^(?:{_IBAN})$",
    rf"(?i)[\[(]at[\])] ?(?:[a-z0-9-]+ ?(?:[\[(]dot[\])]|\.) ?)*(?:{_PROVIDER}) ?(?:[\[(]dot[\])]|\.)",
)
LABELERS = ("format", "gazetteer", "context", "structure", "boundary")
_STATES = 3 ** len(LABELERS)
#: Topics of the words before a span; the last one that is named counts, 0 is none.
TOPICS = (
    "e-?mails?|contact|kontakt|contacto|write|reach|adress[a-z]*|address",
    "call|phone|tel|telefon|mobile|fax|handy|m[oó]vil|t[eé]l[eé]phone",
    "card|karte|tarjeta|carte|visa|iban|konto|account|bank|pay|payment|cuenta|compte",
    "ssn|social security|id|passport|user|login|ip|host",
    "version|isbn|issn|order|ref|section|chapter|fig|table|page|release|build|serial|part|batch|lot|item",
)
#: Lengths at which the next length class begins; shapes are digits, digits with one or several separators, one case, two cases.
LENGTH_STEPS, SHAPES = (10, 14, 20), 5
FEATURES = SHAPES * (len(LENGTH_STEPS) + 1) * (len(TOPICS) + 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""
    total = F.aggregate(
        F.transform(
            F.reverse(F.split(digits, "")),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def iban_checks(value: Column) -> Column:
    """Whether the check digits of an account number hold: it is 1 modulo 97 with letters read as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _valid(rank: int, value: Column) -> Column:
    """Whether a match of a pattern passes its test."""
    if rank == 1:
        return value.rlike(_OCTETS)
    if rank == 2:
        return let(_digits(value), lambda d: F.length(d).between(14, 19) & F.when(F.length(d) <= 19, luhn(d)).otherwise(False))
    if rank == 3:
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _votes(rank: int, value: Column, before: Column, after: Column) -> Column:
    """The votes of the five labelers on a span, as one number: base 3, no 0, nothing 1, yes 2."""
    yes, none, no = F.lit(2), F.lit(1), F.lit(0)
    formats = (
        r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@.*\.[A-Za-z]{2,}$",
        _OCTETS,
        r"^(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{2,7})+)$",
        r"^\+[0-9]{1,3}[ .(-]|^\+[0-9]{10,15}$",
        r"^[(0]",
        r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
        r"^[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4}",
        r"(?i)[\[(]at[\])]",
    )
    form = value.rlike(formats[rank]) & (iban_checks(value) if KINDS[rank] == "iban" else F.lit(True))
    votes = (
        F.when(form, yes).otherwise(no),
        F.when(value.rlike(GAZETTEER[rank]), yes).otherwise(no if rank in (1, 2, 3, 5, 6) else none),
        F.when(before.rlike(FOR_IT), yes).when(before.rlike(AGAINST_IT), no).otherwise(none),
        (
            F.when(value.rlike(r"@(?:localhost|[0-9.]+$)"), no).otherwise(none)
            if rank in (0, 7)
            else F.when((F.size(F.array_distinct(F.split(F.substring(_digits(value), 1, 40), ""))) <= 2) | value.rlike(_ONE_DIGIT), no).otherwise(yes if rank in (2, 3) else none)
        ),
        F.when(before.rlike(r"[A-Za-z0-9_/]$|[0-9][ -]$") | after.rlike(r"^[A-Za-z0-9_]|^[ -][0-9]"), no).otherwise(yes),
    )
    return sum((v * 3**k for k, v in enumerate(votes)), F.lit(0))


def _features(value: Column, before: Column) -> Column:
    """Shape, length class and topic of a span, as one number."""
    seps = F.length(F.regexp_replace(value, "[^ .()/-]", ""))
    shape = (
        F.when(value.rlike(r"[a-z]") & value.rlike(r"[A-Z]"), 4)
        .when(value.rlike(r"[A-Za-z]"), 3)
        .when(seps == 0, 0)
        .when(seps == 1, 1)
        .otherwise(2)
    )
    length = sum(((F.length(value) >= n).cast("int") for n in LENGTH_STEPS), F.lit(0))
    # where each topic is last named; 0 is nowhere
    ends = F.array(*[F.length(F.regexp_extract(before, rf"(?is)^.*\b(?:{t})\b", 0)) for t in TOPICS])
    topic = let(ends, lambda e: F.when(F.array_max(e) > 0, F.array_position(e, F.array_max(e))).otherwise(0))
    return (shape * (len(LENGTH_STEPS) + 1) + length) * (len(TOPICS) + 1) + topic


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,votes:int,features:int>>"


def _candidates(text: Column, rank: int) -> Column:
    """Spans of one pattern that pass its test: (start, rank, end, kind, votes, features)."""
    pattern, hint = PATTERNS[rank], HINTS[rank]
    empty = F.array().cast(_SPANS)

    def of_hits(both: Column) -> Column:
        hits, pieces = both["hits"], both["pieces"]
        gaps = F.transform(hits, lambda h, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(0))
        starts = running_sums(gaps)
        rows = F.transform(
            F.arrays_zip(hits.alias("h"), starts.alias("s")),
            lambda x, i: F.struct(x["h"].alias("h"), x["s"].alias("s"), F.substring(F.get(pieces, i), -CONTEXT, CONTEXT).alias("b"), F.substring(F.get(pieces, i + 1), 1, 2).alias("a")),
        )
        good = F.filter(rows, lambda x: _valid(rank, x["h"]))
        return F.transform(
            good,
            lambda x: F.struct(
                x["s"].alias("start"),
                F.lit(rank).alias("rank"),
                (x["s"] + F.length(x["h"])).alias("end"),
                F.lit(KINDS[rank]).alias("kind"),
                _votes(rank, x["h"], x["b"], x["a"]).cast("int").alias("votes"),
                _features(x["h"], x["b"]).cast("int").alias("features"),
            ),
        )

    def of_all(hits: Column) -> Column:
        pair = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("pieces"))
        return F.when(F.size(hits) > 0, let(pair, of_hits)).otherwise(empty)

    found = let(all_matches(text, pattern), of_all)
    return F.when(text.contains(hint), found).otherwise(empty) if hint else found


def _free(base: Column, others: Column) -> Column:
    """The spans of `others` that overlap none of `base`; both are sorted, and starts are looked up by a running greatest end."""

    def of(x: Column) -> Column:
        # base and other spans in one order; a span overlaps an earlier base span, or a later one that starts inside it
        tagged = F.array_sort(
            F.concat(
                F.transform(x["base"], lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("other"), s["end"].alias("end"), s.alias("s"))),
                F.transform(x["others"], lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("other"), s["end"].alias("end"), s.alias("s"))),
            )
        )

        def marked(t: Column) -> Column:
            ends = running(F.transform(t, lambda r: F.when(r["other"] == 0, r["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
            # the next base start, counted from the right
            limit = F.lit((1 << 31) - 1)
            back = F.reverse(running(F.transform(F.reverse(t), lambda r: F.when(r["other"] == 0, limit - r["start"]).otherwise(0)), lambda a, b: F.greatest(a, b)))
            return let(
                F.struct(ends.alias("ends"), back.alias("back")),
                lambda y: F.transform(
                    F.filter(
                        F.transform(t, lambda r, i: F.struct(r.alias("r"), ((F.get(y["ends"], i) > r["start"]) | (limit - F.get(y["back"], i) < r["end"])).alias("hit"))),
                        lambda z: (z["r"]["other"] == 1) & ~z["hit"],
                    ),
                    lambda z: z["r"]["s"],
                ),
            )

        return F.when((F.size(x["base"]) > 0) & (F.size(x["others"]) > 0), let(tagged, marked)).otherwise(x["others"])

    return let(F.struct(base.alias("base"), others.alias("others")), of)


def candidate_spans(docs: DataFrame, *keep: Column) -> DataFrame:
    """row (a struct of the kept columns), base (spans of the fixed patterns), more (other candidates outside them), sorted; written once."""
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "row",
        F.array_sort(F.concat(*[_candidates(F.col("text"), r) for r in range(BASE)])).alias("base"),
        F.array_sort(F.concat(*[_candidates(F.col("text"), r) for r in range(BASE, len(KINDS))])).alias("others"),
    )
    return written(rows.select("row", "base", _free(F.col("base"), F.col("others")).alias("more")), "candidates")


@dataclass
class SpanModel:
    """Reliabilities from expectation-maximisation and the classifiers trained on its posteriors."""

    prior: list[float]  # kind
    reliability: list[list[list[list[float]]]]  # kind, labeler, class, vote -> probability
    bias: list[float]  # kind
    vote_weight: list[list[list[float]]]  # kind, labeler, vote -> weight
    feature_weight: list[list[list[float]]]  # kind, feature (shape, length, topic), value -> weight

    def score(self, rank: int, votes: list[int], features: list[int] | None = None) -> float:
        """The classifier's log-odds for a span."""
        extra = sum(w[v] for w, v in zip(self.feature_weight[rank], features)) if features else 0.0
        return self.bias[rank] + sum(w[v] for w, v in zip(self.vote_weight[rank], votes)) + extra

    def accepts(self, span: Column) -> Column:
        """`score` > 0 for a span of a row: two look-ups."""
        by_votes = [self.score(r, votes_of(v)) for r in range(len(KINDS)) for v in range(_STATES)]
        by_features = [sum(w[v] for w, v in zip(self.feature_weight[r], features_of(f))) for r in range(len(KINDS)) for f in range(FEATURES)]
        literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
        return F.get(literal(by_votes), span["rank"] * _STATES + span["votes"]) + F.get(literal(by_features), span["rank"] * FEATURES + span["features"]) > 0


def votes_of(code: int) -> list[int]:
    """The votes behind a code."""
    return [code // 3**k % 3 for k in range(len(LABELERS))]


def features_of(code: int) -> list[int]:
    """Shape, length class and topic behind a code."""
    rest, topic = divmod(code, len(TOPICS) + 1)
    return [*divmod(rest, len(LENGTH_STEPS) + 1), topic]


#: What a kind borrows from all kinds together, in candidates; and how strongly weights are held back.
BORROWED, HOLD = 20.0, 0.002


def _sigmoid(z: float) -> float:
    return 1 / (1 + exp(-min(50.0, max(-50.0, z))))


def fit_spans(counts: dict[tuple[int, int, int], int], rounds: int = 60) -> SpanModel:
    """Expectation-maximisation over vote patterns by kind, then logistic regression on its posteriors.

    `counts` has (rank, votes, features) -> candidates. Start: a labeler is right four times in five. No
    candidates of a kind: what all kinds have in common decides; none at all: the start decides.
    """
    kinds, n_lab = range(len(KINDS)), len(LABELERS)
    start = [[[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]] for _ in range(n_lab)]
    rel, prior = [start for _ in kinds], [0.5 for _ in kinds]
    patterns: dict[tuple[int, int], int] = {}
    for (rank, votes, _), n in sorted(counts.items()):
        patterns[rank, votes] = patterns.get((rank, votes), 0) + n

    def posterior(rank: int, votes: list[int]) -> float:
        z = log(prior[rank] / (1 - prior[rank]))
        for k, v in enumerate(votes):
            z += log(rel[rank][k][1][v] / rel[rank][k][0][v])
        return _sigmoid(z)

    for _ in range(rounds):
        # add one, and keep a yes above a no in the class it speaks for
        pooled = [[[3.0, 1.0, 1.0], [1.0, 1.0, 3.0]] for _ in range(n_lab)]
        own = [[[[0.0] * 3 for _ in range(2)] for _ in range(n_lab)] for _ in kinds]
        split = [[0.0, 0.0] for _ in kinds]
        for (rank, code), n in patterns.items():
            votes = votes_of(code)
            p = posterior(rank, votes)
            split[rank][1] += n * p
            split[rank][0] += n * (1 - p)
            for k, v in enumerate(votes):
                for c, share in ((1, p), (0, 1 - p)):
                    own[rank][k][c][v] += n * share
                    pooled[k][c][v] += n * share
        total = [1.0 + sum(s[0] for s in split), 1.0 + sum(s[1] for s in split)]
        common = [[[x / sum(c) for x in c] for c in lab] for lab in pooled]
        prior = [(s[1] + 2 * total[1] / sum(total)) / (sum(s) + 2) for s in split]
        rel = [[[[(x + BORROWED * y) / (sum(c) + BORROWED) for x, y in zip(c, d)] for c, d in zip(lab, com)] for lab, com in zip(own[r], common)] for r in kinds]

    bias = [log(p / (1 - p)) for p in prior]
    vote_w = [[[log(rel[r][k][1][v] / rel[r][k][0][v]) for v in range(3)] for k in range(n_lab)] for r in kinds]
    feature_w = [[[0.0] * SHAPES, [0.0] * (len(LENGTH_STEPS) + 1), [0.0] * (len(TOPICS) + 1)] for _ in kinds]
    for r in kinds:
        mine = [(votes_of(v), features_of(f), n, posterior(r, votes_of(v))) for (rank, v, f), n in sorted(counts.items()) if rank == r]
        total_n = sum(n for *_, n, _ in mine)
        if not total_n:
            continue
        origin = [list(w) for w in vote_w[r]]
        # each candidate is also shown with one vote hidden, so that features learn to stand in for labelers
        hidden = (None, *range(n_lab))
        for _ in range(120):
            g_bias, g_vote, g_feat = 0.0, [[0.0] * 3 for _ in range(n_lab)], [[0.0] * len(w) for w in feature_w[r]]
            for votes, features, n, target in mine:
                said = [w[v] for w, v in zip(vote_w[r], votes)]
                whole = bias[r] + sum(said) + sum(w[v] for w, v in zip(feature_w[r], features))
                for out in hidden:
                    e = n / total_n / len(hidden) * (_sigmoid(whole - (said[out] if out is not None else 0.0)) - target)
                    g_bias += e
                    for k, v in enumerate(votes):
                        if k != out:
                            g_vote[k][v] += e
                    for k, v in enumerate(features):
                        g_feat[k][v] += e
            bias[r] -= 0.5 * g_bias
            vote_w[r] = [[w - 0.5 * (g + HOLD * (w - o)) for w, g, o in zip(a, b, c)] for a, b, c in zip(vote_w[r], g_vote, origin)]
            feature_w[r] = [[w - 0.5 * (g + HOLD * w) for w, g in zip(a, b)] for a, b in zip(feature_w[r], g_feat)]
    return SpanModel(prior, rel, bias, vote_w, feature_w)


def train_spans(candidates: DataFrame) -> SpanModel:
    """Fit on the candidates of all rows; only the counts of (kind, votes, features) are collected."""
    codes = candidates.select(F.explode(F.transform(F.concat("base", "more"), lambda s: F.struct(s["rank"].alias("rank"), s["votes"].alias("votes"), s["features"].alias("features")))).alias("c"))
    return fit_spans({(r["rank"], r["votes"], r["features"]): r["count"] for r in codes.groupBy("c.rank", "c.votes", "c.features").count().collect()})


def _decided(candidates: DataFrame, model: SpanModel) -> DataFrame:
    good = F.filter("more", lambda s: F.coalesce(model.accepts(s), F.lit(False)))
    # a span inside a longer one of them is a part of it
    whole = lambda blocks: lambda s: ~any_span(blocks, s["start"], s["end"] + 1) & ~any_span(blocks, s["start"] - 1, s["end"])
    more = let(good, lambda g: let(in_blocks(g), lambda blocks: F.filter(g, whole(blocks))))
    return candidates.select("row", "base", F.array_sort(F.concat("base", F.when(F.size("more") > 0, more).otherwise(F.col("more")))).alias("found"))


def find_personal_data(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, found: spans (start, rank, end, kind, votes, features) in code points, sorted; one row for each row of `docs`.

    `base` are the fixed patterns that pass their tests, `found` adds what the classifier accepts. A null or
    empty text has no spans; null ids and repeated rows keep their own rows; other columns are not read.
    """
    rows = candidate_spans(id_and_text(docs, id_col, text_col), F.col("doc_id"))
    return _decided(rows, model or train_spans(rows)).select(F.col("row.doc_id").alias("doc_id"), "base", "found")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_more, base_sha256, spans for each document."""
    found = find_personal_data(docs)
    return found.select(
        "doc_id",
        *[of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:BASE]],
        (F.size("found") - F.size("base")).cast("long").alias("n_more"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """`docs` with each span of personal data in `text` replaced by <KIND>; n_chars follows where it is a column.

    Row by row, without a shuffle; a null text stays null. Columns of any name are kept as they are.
    """
    quoted = {c: f"`{c.replace('`', '``')}`" for c in docs.columns}
    rows = candidate_spans(docs, *[F.col(q).alias(f"c{k}") for k, q in enumerate(quoted.values())])
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = _decided(rows, model or train_spans(rows)).select("row.*", "found")
    rows = rows.withColumn(at["text"], replaced(F.col(at["text"]).cast("string"), F.col("found")))
    if "n_chars" in at:
        rows = rows.withColumn(at["n_chars"], F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(k).alias(c) for c, k in at.items()])
