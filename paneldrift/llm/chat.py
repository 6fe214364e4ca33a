"""Chat formatting: conversations of any known layout to one template, and back.

The nested field paths of a table (or of each JSON record) are hashed; the fingerprint selects a declared
mapping that turns the layout into canonical turns (conv_id, turn, role, text). Everything is a DataFrame
expression.

Template: each turn is ``<|role|>text</s>``. Inside role and text, backslash, ``<``, ``[`` and ``>`` are
written as backslash codes, so that no control string can appear there, and decoding is exact.

Defined results: a null text is empty, a null role is the empty role; a null conv_id is a conversation of its
own; null turns come first; equal turn numbers go by role, then text; repeated rows are repeated turns; extra
columns are ignored; an empty table gives an empty table. JSON records may lack fields that their layout calls optional, may have
empty arrays and more fields than it names, and may write conv_id as text; a record of no known layout and bad JSON give one row
with a null layout, no turn, the conv_id if there is one, and the record. One conversation is one value of the result and so must fit a Spark string (2 GB).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Control strings and escape codes of the template.
HEAD, HEAD_END, TURN_END = "<|", "|>", "</s>"
CODES = (("<", "\\l"), ("[", "\\b"), (">", "\\g"))

TURNS = "array<struct<turn: bigint, role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """A source layout: its field paths, and SQL that makes canonical turns of them.

    `turns` is an array expression for layouts of one row per conversation; without it the layout has one row
    per turn and `columns` name turn, role and text.
    """

    name: str
    key: str
    paths: tuple[str, ...]
    schema: str
    turns: str | None = None
    optional: tuple[str, ...] = ("conv_id",)
    columns: tuple[str, str, str] = ("turn", "role", "text")


def _listed(column: str, role: str, text: str) -> str:
    return (
        f"transform({column}, (m, i) -> named_struct('turn', cast(i as bigint), "
        f"'role', CASE lower(m.{role}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.{role} END, "
        f"'text', m.{text}))"
    )


def _fixed(*parts: tuple[str, str]) -> str:
    made = ", ".join(
        f"named_struct('turn', {i}L, 'role', '{role}', 'text', {text})" for i, (role, text) in enumerate(parts)
    )
    return f"filter(array({made}), t -> t.role <> 'system' or t.text is not null)"


LAYOUTS = (
    Layout("turn rows", "conv_id", ("conv_id", "role", "text", "turn"),
           "conv_id bigint, turn bigint, role string, text string"),
    Layout("messages", "conv_id", ("conv_id", "messages[].content", "messages[].role"),
           "conv_id bigint, messages array<struct<role: string, content: string>>",
           _listed("messages", "role", "content")),
    Layout("from and value", "conv_id", ("conv_id", "conversations[].from", "conversations[].value"),
           "conv_id bigint, conversations array<struct<`from`: string, value: string>>",
           _listed("conversations", "`from`", "value")),
    Layout("instruction", "conv_id", ("conv_id", "input", "instruction", "output"),
           "conv_id bigint, instruction string, input string, output string",
           _fixed(("user", r"concat_ws('\n', instruction, nullif(input, ''))"), ("assistant", "output")), ("conv_id", "input")),
    Layout("prompt and response", "conv_id", ("conv_id", "prompt", "response"),
           "conv_id bigint, prompt string, response string", _fixed(("user", "prompt"), ("assistant", "response"))),
    Layout("system, prompt and response", "conv_id", ("conv_id", "prompt", "response", "system"),
           "conv_id bigint, system string, prompt string, response string",
           _fixed(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema: dots between names, [] for elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths) -> str:
    """Hash of the set of paths; order and repetition do not matter."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _forms(layout: Layout) -> list[str]:
    """Fingerprints of a layout with and without each of its optional fields."""
    sets = [set(layout.paths)]
    for name in layout.optional:
        sets += [s - {name} for s in sets]
    return [fingerprint(s) for s in sets]


#: A smaller layout comes before the forms of a larger one that lack fields.
BY_FINGERPRINT = {f: x for x in reversed(LAYOUTS) for f in _forms(x)} | {fingerprint(x.paths): x for x in LAYOUTS}
#: Arrays of messages, with the fields of their elements.
ARRAYS = {p.split("[]")[0]: tuple(q.split("[].")[1] for q in x.paths if q.startswith(p.split("[]")[0] + "[].")) for x in LAYOUTS for p in x.paths if "[]" in p}


def layout_of(df: DataFrame) -> Layout:
    """The layout with the table's fingerprint, else the largest layout whose paths the table has among others."""
    paths = set(paths_of(df.schema))
    found = BY_FINGERPRINT.get(fingerprint(paths))
    within = sorted((x for x in LAYOUTS if set(x.paths) <= paths), key=lambda x: -len(x.paths))
    if not found and not within:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    return found or within[0]


def _canonical(key: Column, turn: Column, role: Column, text: Column) -> list[Column]:
    return [key.alias("conv_id"), turn.cast("bigint").alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
            F.coalesce(text, F.lit("")).alias("text")]


def to_turns(df: DataFrame) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table in any of the declared layouts."""
    layout = layout_of(df)
    if layout.turns is None:
        turn, role, text = layout.columns
        return df.select(*_canonical(df[layout.key], df[turn], df[role], df[text]))
    return df.select(F.col(layout.key).alias("conv_id"), F.inline(F.expr(layout.turns).cast(TURNS))).select(
        *_canonical(*map(F.col, ("conv_id", "turn", "role", "text")))
    )


def record_paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON record, null for what is no object; an empty array has the paths that are declared."""
    lists = F.from_json(record, ", ".join(f"{name} array<map<string, string>>" for name in ARRAYS))

    def of(name: Column) -> Column:
        paths = F.array(name)
        for array, fields in ARRAYS.items():
            elements = lists[array]
            within = F.array_distinct(F.flatten(F.transform(elements, lambda m: F.map_keys(m))))
            told = F.when(F.size(elements) > 0, F.transform(within, lambda f: F.concat(F.lit(f"{array}[]."), f)))
            empty = F.when(F.size(elements) == 0, F.array(*(F.lit(f"{array}[].{f}") for f in fields)))
            paths = F.when(name == array, F.coalesce(told, empty, paths)).otherwise(paths)
        return paths

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.json_object_keys(record), of))))


def records_to_turns(df: DataFrame, record: str = "record") -> DataFrame:
    """Canonical turns of JSON records of mixed layouts: the hash of each record's own field paths selects its mapping, else the
    largest layout whose fields it has among others does.

    Result: layout, conv_id, turn, role, text, and of records without a layout the record. A record without turns gives one row
    in which turn, role and text are null.
    """
    rows = df.select(F.col(record).alias("record")).withColumn("paths", record_paths(F.col("record")))
    by_hash = F.create_map(*(F.lit(v) for f, x in BY_FINGERPRINT.items() for v in (f, x.name)))[F.sha2(F.array_join("paths", "\n"), 256)]
    needed = {x.name: sorted(set(x.paths) - set(x.optional)) for x in sorted(LAYOUTS, key=lambda x: -len(x.paths))}
    within = [F.when(F.size(F.array_except(F.array(*map(F.lit, need)), "paths")) == 0, F.lit(name)) for name, need in needed.items()]
    rows = rows.withColumn("layout", F.coalesce(by_hash, *within)).drop("paths")
    turns, key = F.lit(None).cast(TURNS), F.get_json_object("record", "$.conv_id")
    for x in LAYOUTS:
        data = F.from_json("record", x.schema.replace("conv_id bigint", "conv_id string"))
        made = F.expr(x.turns or "array(named_struct('turn', turn, 'role', role, 'text', text))").cast(TURNS)
        names = [f.name for f in T._parse_datatype_string(x.schema).fields]
        hit = F.col("layout") == x.name
        rows = rows.withColumn("data", F.when(hit, data)).withColumns({n: F.col("data")[n] for n in names if n != "conv_id"})
        rows = rows.withColumn(f"turns {x.name}", F.when(hit, made)).drop("data", *(n for n in names if n != "conv_id"))
        turns = F.coalesce(F.col(f"turns {x.name}"), turns)
    left = F.when(F.col("layout").isNull(), F.col("record"))
    each = rows.select("layout", key.try_cast("bigint").alias("conv_id"), left.alias("record"), F.explode_outer(turns).alias("t"))
    told = [F.when(F.col("t").isNotNull(), F.coalesce(F.col(f"t.{n}"), F.lit(""))).alias(n) for n in ("role", "text")]
    return each.select("layout", "conv_id", "t.turn", *told, "record")


def as_records(turns: DataFrame) -> DataFrame:
    """Canonical turns as JSON records, one for each conversation, in one of the layouts that can hold it, chosen by its id."""
    turn = F.struct("turn", "role", "text")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    role, text = F.col("t.role"), lambda i: F.get("t", F.lit(i))["text"]
    named = F.forall("t", lambda m: F.lower(m["role"]).isin("user", "assistant", "system") & (m["role"] == F.lower(m["role"])))
    pair = role == F.array(F.lit("user"), F.lit("assistant"))
    triple = role == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    messages = F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    renamed = F.transform("t", lambda m: F.struct(
        F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), m["text"].alias("value")))
    key = F.col("conv_id")
    pick = F.pmod(F.coalesce(key, F.lit(0)), F.lit(3))
    plain = ~F.exists("t", lambda m: F.lower(m["role"]).isin("human", "gpt"))
    record = (
        F.when(pair & (pick == 0), F.to_json(F.struct(key, text(0).alias("prompt"), text(1).alias("response"))))
        .when(pair & (pick == 1), F.to_json(F.struct(key, text(0).alias("instruction"), text(1).alias("output"))))
        .when(triple, F.to_json(F.struct(key, text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(named & (pick != 2), F.to_json(F.struct(key, renamed.alias("conversations"))))
        .when(plain, F.to_json(F.struct(key, messages.alias("messages"))))
    )
    # Roles that a layout would rename are told turn by turn.
    single = F.transform("t", lambda m: F.to_json(F.struct(key, m["turn"].alias("turn"), m["role"].alias("role"), m["text"].alias("text"))))
    return rows.select(F.explode(F.when(record.isNotNull(), F.array(record)).otherwise(single)).alias("record"))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Inverse of `escape`: double backslashes split the text, so no code is taken across one."""
    def plain(part: Column) -> Column:
        for p, code in CODES:
            part = F.replace(part, F.lit(code), F.lit(p))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    `loss_spans` marks what the loss is taken on: for each turn of `trained_role` its place among the turns and the
    start and length of its escaped text within that turn's piece, in code points.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(HEAD), role, F.lit(HEAD_END))
    piece = F.struct(
        "turn", "role", "text", F.concat(head, text, F.lit(TURN_END)).alias("piece"),
        F.char_length(head).alias("start"), F.char_length(text).alias("length"),
    )
    rows = turns.select("conv_id", piece.alias("piece")).groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    spans = F.transform("pieces", lambda p, i: F.struct(p["role"].alias("role"), i.alias("piece"), p["start"].alias("start"), p["length"].alias("length")))
    trained = F.transform(F.filter(spans, lambda s: s["role"] == trained_role), lambda s: F.struct(*(s[n].alias(n) for n in ("piece", "start", "length"))))
    return rows.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), trained.alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, turns (role, text), trained_text, and the number of characters."""
    pieces = F.slice(F.split("formatted", TURN_END, -1), 1, F.size(F.split("formatted", TURN_END, -1)) - 1)
    cut = chats.select("conv_id", pieces.alias("pieces"), "loss_spans", F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    mark = len(HEAD)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, HEAD_END, 1)
        text = F.substring(p, F.char_length(role) + len(HEAD_END) + 1, F.char_length(p))
        return F.struct(unescape(F.substring(role, F.lit(mark + 1), F.char_length(role))).alias("role"), unescape(text).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.get("pieces", s["piece"]), s["start"] + 1, s["length"])))
    return cut.select("conv_id", F.transform("pieces", turn).alias("turns"), F.array_join(masked, "").alias("trained_text"), "formatted_chars")


def digests(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what `read_chats` gives."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(chats).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("trained_text").cast("bigint").alias("loss_chars"), F.sha2("trained_text", 256).alias("loss_sha256"), "formatted_chars",
    )
