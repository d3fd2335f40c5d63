"""Chat formatting: records of any known layout become canonical turns, then one marked text.

A record is a JSON text. The paths of its nested fields, without the types of the leaves, are
hashed to a fingerprint; a declarative mapping is chosen by that fingerprint and says where the
turns are. Everything is a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {
    "system": "system",
    "user": "user",
    "human": "user",
    "prompter": "user",
    "assistant": "assistant",
    "gpt": "assistant",
    "bot": "assistant",
    "model": "assistant",
    "tool": "tool",
    "function": "tool",
}
HEAD, END = "### ", "</turn>\n"
# Control strings in a text are replaced; the escape character itself comes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``fields``: (path, role) in order, for layouts with one field a turn; ``items``: (path of
    the array, role key, text key) for layouts with a list. A layout may have both, the fields
    come first. ``join``: (path, path whose text follows it after a blank line). ``keep_roles``:
    the roles of ``items`` are taken as they are.
    """

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    join: tuple[tuple[str, str], ...] = ()
    keep_roles: bool = False


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Mapping("messages_id", ("id", "messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Mapping("turns", ("turns[].role", "turns[].text"), items=("turns", "role", "text"), keep_roles=True),
    Mapping("share", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Mapping("share_system", ("conversations[].from", "conversations[].value", "system"), (("system", "system"),), ("conversations", "from", "value")),
    Mapping("prompt_response", ("prompt", "response"), (("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt_completion", ("completion", "prompt"), (("prompt", "user"), ("completion", "assistant"))),
    Mapping("system_prompt_response", ("prompt", "response", "system"), (("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("instruction", ("instruction", "output"), (("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction_input", ("input", "instruction", "output"), (("instruction", "user"), ("output", "assistant")), join=(("instruction", "input"),)),
    Mapping("question_answer", ("answer", "question"), (("question", "user"), ("answer", "assistant"))),
)


def path_list(record: Column) -> Column:
    """The tree of nested fields of a variant, in order of their names and without leaf types.

    ``schema_of_variant`` merges the elements of a list; ``{"a": 1}`` and ``{"a": "x"}`` agree.
    """
    tree = F.regexp_replace(F.schema_of_variant(record), r": (?!ARRAY<|OBJECT<)[A-Z_]+(\([0-9, ]+\))?", "")
    return F.regexp_replace(tree, r"ARRAY<(?!ARRAY<|OBJECT<)[A-Z_]+(\([0-9, ]+\))?>", "ARRAY<>")


def tree_of(paths: tuple[str, ...]) -> str:
    """The text that :func:`path_list` gives for these paths."""

    def grow(parts: list[list[str]]) -> str:
        heads: dict[str, list[list[str]]] = {}
        for p in parts:
            heads.setdefault(p[0], []).append(p[1:])
        return ", ".join(name.rstrip("[]") + kind(name, rest) for name, rest in sorted(heads.items()))

    def kind(name: str, rest: list[list[str]]) -> str:
        below = f"OBJECT<{grow([r for r in rest if r])}>" if any(rest) else ""
        return (f": ARRAY<{below}>" if name.endswith("[]") else f": {below}") if below or name.endswith("[]") else ""

    return f"OBJECT<{grow([p.split('.') for p in paths])}>"


def fingerprint(record: Column) -> Column:
    """Hex hash of the nested field paths of a variant."""
    return F.substring(F.sha2(path_list(record), 256), 1, 16)


def _turns(record: Column, m: Mapping) -> Column:
    def text(path: str) -> Column:
        return F.variant_get(record, f"$.{path}", "string")

    parts = []
    joined = dict(m.join)
    for path, role in m.fields:
        value = text(path)
        if path in joined:
            more = text(joined[path])
            value = F.when(F.coalesce(more, F.lit("")) != "", F.concat_ws("\n\n", value, more)).otherwise(value)
        parts.append(F.array(F.struct(F.lit(role).alias("role"), F.coalesce(value, F.lit("")).alias("text"))))
    if m.items:
        path, role_key, text_key = m.items
        items = F.variant_get(record, f"$.{path}", f"array<struct<`{role_key}`: string, `{text_key}`: string>>")
        parts.append(
            F.transform(
                items,
                lambda x: F.struct((F.coalesce(x[role_key], F.lit("")) if m.keep_roles else canonical_role(x[role_key])).alias("role"), F.coalesce(x[text_key], F.lit("")).alias("text")),
            )
        )
    return F.concat(*parts)


def canonical_role(role: Column) -> Column:
    """Known names in any case become the canonical one; others, and null as '', stay."""
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = F.coalesce(role, F.lit(""))
    return F.coalesce(F.element_at(known, F.lower(role)), role)


def canonical_turns(records: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``layout_fingerprint``, ``layout`` and ``turns`` (array of role and text).

    Records that are no JSON, null, or of an unknown layout keep their row with null ``layout``
    and null ``turns``, so that a new mapping can be declared from the fingerprint. A field that
    is null or absent in one element of a list is an empty text. Existing columns of these
    three names are replaced.
    """
    record = F.col("__record")
    fp = F.col("layout_fingerprint")
    base = records.drop("layout_fingerprint", "layout", "turns").withColumn("__record", F.try_parse_json(F.col(json_col)))
    base = base.withColumn("layout_fingerprint", fingerprint(record))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    for m in reversed(mappings):
        hit = fp == F.substring(F.sha2(F.lit(tree_of(m.paths)), 256), 1, 16)
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, _turns(record, m)).otherwise(turns)
    return base.withColumn("layout", layout).withColumn("turns", turns).drop("__record")


def escape(text: Column) -> Column:
    for plain, marked in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """Undo :func:`escape`: pairs of backslashes are set aside so that none is read twice."""

    def plain_part(part: Column) -> Column:
        for plain, marked in escapes[1:]:
            part = F.replace(part, F.lit(marked), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, "\\\\\\\\", -1), plain_part), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(role, (*ESCAPES, ("\n", "\\n")))


def format_chat(records: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``.

    A turn is ``### role``, a line end, the text, ``</turn>`` and a line end; control strings in
    role and text are escaped. ``loss_spans`` has start and length (code points, in ``formatted``)
    of each assistant text. Null turns give null; no turns give an empty text.
    """
    marked = F.transform(
        F.col(turns_col),
        lambda t: F.struct(F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), t["role"].alias("role")),
    )
    rows = records.withColumn("__marked", marked)
    rows = rows.withColumn(
        "formatted",
        F.array_join(F.transform("__marked", lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = F.length(t["body"]).cast("long")
        begin = acc["at"] + F.length(t["head"])
        span = F.array(F.struct(begin.alias("start"), body.alias("length")))
        return F.struct(
            (begin + body + len(END)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return rows.withColumn("loss_spans", F.aggregate("__marked", start, step, lambda acc: acc["spans"])).drop("__marked")


def read_back(formatted: DataFrame, text_col: str = "formatted") -> DataFrame:
    """Adds ``read_turns``: the turns that the marked text says, unescaped."""
    pieces = F.split(F.col(text_col), F.lit(END), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        return F.struct(
            unescape_role(F.substring(piece, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(piece, cut + 1, F.length(piece))).alias("text"),
        )

    return formatted.withColumn("read_turns", F.transform(pieces, turn))


def under_mask(text: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def gather_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows (conv_id, turn, role, text) of one conversation as JSON.

    Turns are in order of ``turn`` (null first); rows with the same number are ordered by role,
    then text. Null text is empty. The layout is the tightest that holds the conversation: a
    prompt and its response, with or without a system line, else a list of turns.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    shape = F.array_join(F.transform("t", lambda t: t["role"]), "\n")
    at = lambda k: F.col("t")[k]["text"]
    pair = F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response")))
    triple = F.to_json(F.struct(at(0).alias("system"), at(1).alias("prompt"), at(2).alias("response")))
    listed = F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))
    return convs.select(
        "conv_id",
        F.when((F.size("t") == 2) & (shape == "user\nassistant"), pair)
        .when((F.size("t") == 3) & (shape == "system\nuser\nassistant"), triple)
        .otherwise(listed)
        .alias("record"),
    )
