"""Row mapping: JSON pointers, payload schemas, trainer profiles."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import derived_id  # noqa: F401 (identities of rows)


def _tokens(pointer: str) -> list[str]:
    """The keys of a JSON pointer; a bare key is one."""
    return [p.replace("~1", "/").replace("~0", "~") for p in (pointer if pointer.startswith("/") else f"/{pointer}").split("/")[1:]]


def _index(token: str) -> int | None:
    try:
        return int(token)
    except ValueError:
        return None


def _member(value: Column, token: str) -> Column:
    """A member of an object, as a variant; null where there is none or no object. Any key goes, with quotes or digits too."""
    if "'" in token and '"' in token:
        return F.element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(token))
    quote = '"' if "'" in token else "'"
    return F.try_variant_get(value, f"$[{quote}{token}{quote}]", "variant")


def _child(value: Column, token: str) -> Column:
    """A member of an object, or an element of a list."""
    index, member = _index(token), _member(value, token)
    return member if index is None or index < 0 else F.coalesce(member, F.try_variant_get(value, f"$[{index}]", "variant"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def value_at(payload: Column, pointer: str) -> Column:
    """The value at a pointer as a variant; null where there is none."""
    value = F.try_parse_json(payload)
    for token in _tokens(pointer):
        value = _child(value, token)
    return value


def _as_text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def resolve(payload: Column, pointer: str) -> Column:
    """The value at a pointer as text (strings as they are, others as JSON); null where there is none, and for JSON null."""
    value = value_at(payload, pointer)
    return F.when(_kind(value) != "VOID", _as_text(value))


def kind_at(payload: Column, pointer: str) -> Column:
    """The JSON type at a pointer (STRING, VOID for JSON null, ...); null where there is nothing or no JSON."""
    return _kind(value_at(payload, pointer))


def strict_scalar(payload: Column, pointer: str) -> Column:
    """struct(value, encoding) of the scalar at a canonical pointer; null where it is refused.

    The pointer begins with a slash, list indexes are whole numbers without leading zeros, and the leaf is a
    string (taken as it is), a whole number, true, false or null (as JSON).
    """
    if not pointer.startswith("/"):
        raise ValueError("a canonical pointer begins with a slash")
    value = F.try_parse_json(payload)
    for token in _tokens(pointer):
        index = int(token) if re.fullmatch("0|[1-9][0-9]*", token) else None
        member = _member(value, token)
        value = member if index is None else F.when(_kind(value).startswith("ARRAY"), F.try_variant_get(value, f"$[{index}]", "variant")).otherwise(member)
    kind, text = _kind(value), F.to_json(value)
    whole = kind.isin("BIGINT", "VOID", "BOOLEAN") | (kind.startswith("DECIMAL") & text.rlike("^-?[0-9]+$"))
    return F.when(kind == "STRING", F.struct(F.try_variant_get(value, "$", "string").alias("value"), F.lit("identity-string").alias("encoding"))).when(
        whole, F.struct(text.alias("value"), F.lit("json-scalar-v1").alias("encoding"))
    )


def pointer_code(payload: Column, pointer: str) -> Column:
    """Why a pointer has no value: missing-source-path, or invalid-mapped-fields where it goes through a scalar or names a list by a word."""
    value, code = F.try_parse_json(payload), None
    for token in _tokens(pointer):
        kind, child = _kind(value), _child(value, token)
        in_list = F.lit("missing-source-path") if (_index(token) is not None) else F.lit("invalid-mapped-fields")
        here = F.when(kind.startswith("OBJECT"), F.when(child.isNull(), "missing-source-path"))
        # a row that is no object has nothing at its first key
        here = here.otherwise("missing-source-path") if code is None else here.when(kind.startswith("ARRAY"), F.when(child.isNull(), in_list)).otherwise("invalid-mapped-fields")
        code, value = here if code is None else F.coalesce(code, here), child
    return code


def _keys(value: Column) -> Column:
    return F.array_sort(F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>")))


def _string(value: Column, key: str) -> Column:
    """A member that is a string, else null."""
    member = _member(value, key)
    return F.when(_kind(member) == "STRING", F.try_variant_get(member, "$", "string"))


def _is_keys(value: Column, *keys: str) -> Column:
    return _kind(value).startswith("OBJECT") & (_keys(value) == F.array(*map(F.lit, sorted(keys))))


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _first(codes: Column) -> Column:
    return F.get(F.filter(codes, lambda c: c.isNotNull()), F.lit(0))


_LIST = "array<variant>"
BAD_TURNS, BLANK = "invalid-messages", "empty-required-string"


def messages_code(value: Column) -> Column:
    """Why a variant is not a user turn and an assistant turn of (role, content); null if it is."""

    def turn(t: Column, role: str) -> Column:
        shaped = _is_keys(t, "role", "content") & _string(t, "role").eqNullSafe(role)
        return F.when(~F.coalesce(shaped, F.lit(False)), BAD_TURNS).when(~_filled(_string(t, "content")), BLANK)

    turns = F.try_variant_get(value, "$", _LIST)
    both = F.coalesce(turn(F.get(turns, F.lit(0)), "user"), turn(F.get(turns, F.lit(1)), "assistant"))
    return F.when(~F.coalesce(F.size(turns) == 2, F.lit(False)), BAD_TURNS).otherwise(both)


def tool_turns_code(value: Column) -> Column:
    """Why a variant is not a tool trace; null if it is. Its first failing turn decides."""

    def call(c: Column) -> Column:
        return F.when(~F.coalesce(_is_keys(c, "arguments", "id", "name"), F.lit(False)), BAD_TURNS).when(~(_filled(_string(c, "arguments")) & _filled(_string(c, "id")) & _filled(_string(c, "name"))), BLANK)

    def turn(t: Column) -> Column:
        role, calls = _string(t, "role"), F.try_variant_get(_member(t, "tool_calls"), "$", _LIST)
        by_tool = role.isin("tool", "function")
        has_calls = F.array_contains(_keys(t), "tool_calls")
        listed = F.when(~F.coalesce(F.size(calls) > 0, F.lit(False)), BAD_TURNS).otherwise(_first(F.transform(calls, call)))
        shape = (
            F.when(role == "user", _is_keys(t, "content", "role"))
            .when(role == "assistant", _is_keys(t, "content", "role") | _is_keys(t, "content", "role", "tool_calls"))
            .otherwise(_is_keys(t, "content", "role", "tool_call_id"))
        )
        return (
            F.when(~F.coalesce(role.isin("user", "assistant", "tool", "function"), F.lit(False)), BAD_TURNS)
            .when(~_filled(_string(t, "content")), BLANK)
            .when(~F.coalesce(shape, F.lit(False)), BAD_TURNS)
            .when(by_tool & ~_filled(_string(t, "tool_call_id")), BLANK)
            .when((role == "assistant") & has_calls, listed)
        )

    turns = F.try_variant_get(value, "$", _LIST)
    traced = F.exists(turns, lambda t: F.coalesce(_string(t, "role").isin("tool", "function"), F.lit(False)) | F.array_contains(_keys(t), "tool_calls"))
    last = F.get(turns, F.size(turns) - 1)
    ended = _string(last, "role").eqNullSafe("assistant") & ~F.array_contains(_keys(last), "tool_calls")
    return F.when(~F.coalesce(F.size(turns) >= 3, F.lit(False)), BAD_TURNS).otherwise(F.coalesce(_first(F.transform(turns, turn)), F.when(~(traced & ended), BAD_TURNS)))


def steps_code(value: Column) -> Column:
    """Why a variant is not a list of two filled strings or more; null if it is."""
    steps = F.try_variant_get(value, "$", _LIST)
    good = (F.size(steps) >= 2) & F.forall(steps, lambda s: (_kind(s) == "STRING") & _filled(F.try_variant_get(s, "$", "string")))
    return F.when(~F.coalesce(good, F.lit(False)), BLANK)


def _text_code(value: Column) -> Column:
    return F.when(_kind(value) != "STRING", "non-string-value").when(F.try_variant_get(value, "$", "string") == "", BLANK)


# The keys of each row schema, in their order.
ROW_SCHEMAS = {
    "text": ("text",),
    "prompt_completion": ("prompt", "completion"),
    "instruction_output": ("instruction", "input", "output"),
    "messages": ("messages",),
    "label-classification": ("context", "label", "annotator"),
    "preference-pair": ("prompt", "chosen", "rejected"),
    "tool-call-conversation": ("conversation_id", "turns"),
    "stepwise-trace": ("prompt", "steps"),
}
#: Keys whose value is a list, by schema.
_LISTS = {("messages", "messages"): messages_code, ("tool-call-conversation", "turns"): tool_turns_code, ("stepwise-trace", "steps"): steps_code}


def value_code(row_schema: str | None, key: str, value: Column) -> Column:
    """Why a value does not fit a key of a row schema; null if it does."""
    return _LISTS.get((row_schema, key), _text_code)(value)


def map_rows(rows: DataFrame, payload: str, fields: dict[str, str]) -> DataFrame:
    """`rows` with one column for each field and `reject`: why a row cannot be mapped, else null. Only strings are taken, nothing is turned into text."""
    text = lambda p: F.when(kind_at(F.col(payload), p) == "STRING", resolve(F.col(payload), p))
    return rows.select("*", *[text(p).alias(f) for f, p in fields.items()], reject_code(F.col(payload), fields).alias("reject"))


def mapped(rows: DataFrame, payload: str, fields: dict[str, str], row_schema: str | None = None, membership: str = "replaced") -> tuple[DataFrame, DataFrame]:
    """The rows that can be mapped, and the others with `reason_code`; a mapping that takes no row at all is an error."""
    judged = rows.withColumn("reason_code", reject_code(F.col(payload), fields, membership, row_schema))
    good = judged.filter("reason_code is null")
    if good.isEmpty():
        raise ValueError("the mapping accepts no row")
    text = lambda f, p: F.to_json(value_at(F.col(payload), p)) if (row_schema, f) in _LISTS else resolve(F.col(payload), p)
    return good.drop("reason_code").select("*", *[text(f, p).alias(f) for f, p in fields.items()]), judged.filter("reason_code is not null")


def alpaca(rows: DataFrame) -> DataFrame:
    """(prompt, completion) as (instruction, input, output) with an empty input."""
    return rows.select(*[c for c in rows.columns if c not in ("prompt", "completion")], F.col("prompt").alias("instruction"), F.lit("").alias("input"), F.col("completion").alias("output"))


def first_exchanges(turns: DataFrame) -> DataFrame:
    """conv_id, prompt, completion: the first user turn and the first assistant turn after it."""
    users = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("u"))
    pairs = turns.filter("role = 'assistant'").join(users, "conv_id").filter(F.col("turn") > F.col("u.turn"))
    return pairs.groupBy("conv_id").agg(F.first("u.text").alias("prompt"), F.min(F.struct("turn", "text"))["text"].alias("completion"))


def reject_code(payload: Column, fields: dict[str, str], membership: str = "replaced", row_schema: str | None = None) -> Column:
    """Why a row cannot be mapped, first failing check first; null if it can. One of seven codes.

    Keys that no field reads are refused, then field by field paths without a value, values that are not strings
    (lists where the row schema has them), empty strings, turns out of order and, unless membership is replaced, a
    partition other than train or evaluation. A row that is no object has no keys and fails at its first path.
    """
    known = [_tokens(p)[0] for p in fields.values()] + ([] if membership == "replaced" else ["partition"])
    extra = F.size(F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.array(*map(F.lit, known)))) > 0
    codes = [F.when(extra, "unmapped-keys")]
    for key, pointer in fields.items():
        codes += [pointer_code(payload, pointer), value_code(row_schema, key, value_at(payload, pointer))]
    if membership != "replaced":
        codes.append(F.when(~F.coalesce(resolve(payload, "partition").isin("train", "evaluation"), F.lit(False)), "invalid-partition"))
    return F.coalesce(*codes)


def contract_code(payload: Column, row_schema: str) -> Column:
    """Why a JSON object is no row of a schema; null if it is: exactly the schema's keys, each with a fitting value."""
    keys = ROW_SCHEMAS[row_schema]
    exact = F.coalesce(_is_keys(F.try_parse_json(payload), *keys), F.lit(False))
    return F.when(~exact, "wrong-keys").otherwise(F.coalesce(*[value_code(row_schema, k, value_at(payload, k)) for k in keys]))


def rejections(rows: DataFrame, payload: str, fields: dict[str, str], membership: str = "replaced", row_schema: str | None = None) -> DataFrame:
    """reason_code (null: accepted), n."""
    return rows.groupBy(reject_code(F.col(payload), fields, membership, row_schema).alias("reason_code")).agg(F.count(F.lit(1)).alias("n"))


# The row schema that each detector proposes, and the goal that goes with it.
DETECTORS = {
    "flat-text": ("text", "learn-the-text"),
    "prompt-completion": ("prompt_completion", "continue-a-passage"),
    "alpaca-instruction-output": ("instruction_output", "continue-a-passage"),
    "two-turn-messages": ("messages", "continue-a-passage"),
    "split-jsonl-payload": ("text", "learn-the-text"),
    "context-label-annotator": ("label-classification", "classify-with-provided-labels"),
    "prompt-chosen-rejected": ("preference-pair", "prefer-chosen-over-rejected"),
    "conversation-and-tool-trace": ("tool-call-conversation", "use-provided-tool-traces"),
    "prompt-and-steps": ("stepwise-trace", "use-provided-steps"),
}
#: Ready mappings: a name, and the detector whose row schema it maps key by key.
TEMPLATES = {
    "instruction-output": "alpaca-instruction-output",
    "two-turn-messages": "two-turn-messages",
    "prompt-completion": "prompt-completion",
    "flat-text": "flat-text",
    "context-label": "context-label-annotator",
    "preference-pair": "prompt-chosen-rejected",
    "tool-call-conversation": "conversation-and-tool-trace",
    "stepwise-trace": "prompt-and-steps",
}


def detect(rows: DataFrame, payload: str) -> DataFrame:
    """detector, row_schema, proposed: whether every row has a fitting value for all keys of a schema; one pass. An empty table proposes none."""

    def fits(row_schema: str) -> Column:
        codes = [F.coalesce(pointer_code(F.col(payload), k), value_code(row_schema, k, value_at(F.col(payload), k))) for k in ROW_SCHEMAS[row_schema]]
        return F.coalesce(*codes).isNull()

    # detectors of one schema share its flag
    flags = {s: F.coalesce(F.bool_and(fits(s)), F.lit(False)) for s, _ in DETECTORS.values()}
    found = [F.struct(F.lit(d).alias("detector"), F.lit(s).alias("row_schema"), flags[s].alias("proposed")) for d, (s, _) in DETECTORS.items()]
    return rows.agg(F.array(*found).alias("f")).select(F.inline("f"))


def template(name: str, membership: str = "replaced") -> dict:
    """A mapping plan (goal, row_schema, fields, membership) by name."""
    row_schema, goal = DETECTORS[TEMPLATES[name]]
    return {"goal": goal, "row_schema": row_schema, "fields": {k: k for k in ROW_SCHEMAS[row_schema]}, "membership": membership}


def confirmation(plan: dict, sources: dict[str, str]) -> str:
    """The digest that a plan is confirmed by: it binds goal, schema, fields and the digests of the sources (path -> sha256)."""
    body = {"goal": plan["goal"], "row_schema": plan["row_schema"], "fields": list(plan["fields"].items()), "sources": sorted(sources.items())}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def confirmed(plan: dict, sources: dict[str, str], digest: str) -> dict:
    """The plan, if `digest` confirms it for these sources; anything else is an error."""
    if confirmation(plan, sources) != digest:
        raise ValueError("the plan is not confirmed for these sources")
    return plan


#: Bytes of a sample that a preview shows.
SAMPLE_BYTES = 65_536


def preview(rows: DataFrame, payload: str, fields: dict[str, str], row_schema: str | None = None, membership: str = "replaced", limit: int = SAMPLE_BYTES) -> DataFrame:
    """`rows` with status, reason_code, sample and omission: samples of rejected rows and of those over `limit` bytes are left out."""
    judged = rows.withColumn("reason_code", reject_code(F.col(payload), fields, membership, row_schema))
    large = F.octet_length(payload) > limit
    status = F.when(F.col("reason_code").isNull(), "accepted").otherwise("rejected")
    good = F.col("reason_code").isNull()
    return judged.select("*", status.alias("status"), F.when(good & ~large, F.col(payload)).alias("sample"), F.when(good & large, f"sample-exceeds-{limit}-bytes").alias("omission"))


# Context and target fields of each objective.
ROLES = {
    "full_text": ("text", "text"),
    "continuation": ("prompt", "completion"),
    "section_reconstruction": ("heading", "section"),
    "before_after_transformation": ("before", "after"),
    "structured_field": ("input", "fields"),
    "explicit_label": ("context", "label"),
    "preference_pair": ("prompt", "chosen"),
    "tool_call": ("conversation_id", "turns"),
    "stepwise": ("prompt", "steps"),
}
#: Objectives whose records come from rows only: a document cannot supply what they need.
IMPORT_ONLY = ("explicit_label", "preference_pair", "tool_call", "stepwise")


def in_roles(records: DataFrame, objective: str) -> DataFrame:
    """`records` with the objective's fields as `context` and `target`."""
    context, target = ROLES[objective]
    return records.select(*[c for c in records.columns if c not in (context, target)], F.col(context).alias("context"), F.col(target).alias("target"))


def messages_ok(messages: Column) -> Column:
    """Whether an array of (role, content) is one user and one assistant turn with content."""
    full = F.forall(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return F.coalesce((F.size(messages) == 2) & F.get(messages, F.lit(0))["role"].eqNullSafe("user") & F.get(messages, F.lit(1))["role"].eqNullSafe("assistant") & full, F.lit(False))


def steps_ok(steps: Column) -> Column:
    """Whether there are two steps or more, none empty."""
    return F.coalesce((F.size(steps) >= 2) & F.forall(steps, lambda s: F.coalesce(s, F.lit("")) != ""), F.lit(False))


def tool_turns_ok(turns: Column) -> Column:
    """Whether an array of (role, content, tool_call_id, tool_calls) is a tool trace.

    Three turns or more with content; users carry neither id nor calls, assistants no id; tool and function turns an id;
    calls, where given, are complete; a call or a tool turn occurs; the last turn is an assistant's without calls.
    """
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    calls_ok = lambda t: (F.size(t["tool_calls"]) > 0) & F.forall(t["tool_calls"], lambda c: filled(c["id"]) & filled(c["name"]) & filled(c["arguments"]))
    by_tool = lambda t: t["role"].isin("tool", "function")

    def turn_ok(t):
        user = (t["role"] == "user") & t["tool_call_id"].isNull() & t["tool_calls"].isNull()
        assistant = (t["role"] == "assistant") & t["tool_call_id"].isNull() & (t["tool_calls"].isNull() | calls_ok(t))
        tool = by_tool(t) & filled(t["tool_call_id"]) & t["tool_calls"].isNull()
        return F.coalesce(filled(t["content"]) & (user | assistant | tool), F.lit(False))

    last = F.element_at(turns, -1)
    traced = F.exists(turns, lambda t: by_tool(t) | t["tool_calls"].isNotNull())
    return F.coalesce(F.when(F.size(turns) >= 3, F.forall(turns, turn_ok) & traced & (last["role"] == "assistant") & last["tool_calls"].isNull()), F.lit(False))


def payload_json(row_schema: str, context: Column, target: Column, extra: Column | None = None) -> Column:
    """A row of one of the eight schemas as JSON with sorted keys.

    `extra` is the instruction, the annotator or the rejected answer, where the schema has one; turns and steps are
    arrays in `target`.
    """
    turn = lambda role, content: F.struct(content.alias("content"), F.lit(role).alias("role"))
    shapes = {
        "text": lambda: [target.alias("text")],
        "prompt_completion": lambda: [target.alias("completion"), context.alias("prompt")],
        "instruction_output": lambda: [context.alias("input"), extra.alias("instruction"), target.alias("output")],
        "messages": lambda: [F.array(turn("user", context), turn("assistant", target)).alias("messages")],
        "label-classification": lambda: [extra.alias("annotator"), context.alias("context"), target.alias("label")],
        "preference-pair": lambda: [target.alias("chosen"), context.alias("prompt"), extra.alias("rejected")],
        "tool-call-conversation": lambda: [context.alias("conversation_id"), target.alias("turns")],
        "stepwise-trace": lambda: [context.alias("prompt"), target.alias("steps")],
    }
    return F.to_json(F.struct(*shapes[row_schema]()))


def assemble_prompt(rows: DataFrame) -> DataFrame:
    """(instruction, input, output) as (prompt, completion): instruction and input on two lines, or the instruction alone."""
    rest = [c for c in rows.columns if c not in ("instruction", "input", "output")]
    prompt = F.when(F.coalesce("input", F.lit("")) == "", F.col("instruction")).otherwise(F.concat_ws("\n", "instruction", "input"))
    return rows.select(*rest, prompt.alias("prompt"), F.col("output").alias("completion"))


def sharegpt(rows: DataFrame) -> DataFrame:
    """(prompt, completion) as `conversations`: turns of (from, value) by human and gpt."""
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), F.col(value).alias("value"))
    return rows.select(*[c for c in rows.columns if c not in ("prompt", "completion")], F.array(turn("human", "prompt"), turn("gpt", "completion")).alias("conversations"))
