"""Chat formatting by schema fingerprints.

A record is JSON of any layout. Its fingerprint is a hash of its nested field paths (names and nesting, without the
types of values), and selects a declarative mapping: where the turns are, and which role and text each has. Known
layouts: lists of messages (role/content or from/value), prompt/response and prompt/completion, instruction/output
with or without input or system. The canonical turns are written with a template

    <s>[INST]role[/INST]text</s>

and every control string inside a role or text gets one more backslash after its first character; removing one gives
the text back, whatever it holds. The loss mask lists start and length, in code points, of each assistant text.

The JSON reader of variants takes strings of up to 20,000,000 characters, and a variant holds 128 MiB. Longer records
that it refuses are read as maps of strings without these limits, and their mapping follows from their keys; if no
mapping reads such a record, the query fails rather than lose it. What is left is Spark's limit of 2 GB a value.

Only DataFrame functions are used. A shorter record that is no JSON, or of a layout without a mapping, comes out with null
turns and its fingerprint, never dropped. Null roles and texts are empty. A record with no turns is an empty string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
OPEN, CLOSE, END = "<s>[INST]", "[/INST]", "</s>"
#: A record of fewer characters reaches no limit of the variant reader on strings or size.
LONG = 20_000_000
WIDE = {"maxStringLen": str((1 << 31) - 1), "mode": "PERMISSIVE"}
_CONTROL = r"(/?(?:s>|INST\]))"


@dataclass(frozen=True)
class Mapping:
    """`paths`: the structure of the record. `turns`: pairs of role and path; or `many`: path, role and text fields."""

    name: str
    paths: str
    turns: tuple[tuple[str, str], ...] = ()
    many: tuple[str, str, str] | None = None


def _flat(*fields: str) -> str:
    return "OBJECT<" + ", ".join(sorted(fields)) + ">"


def _list(field: str, *inner: str) -> str:
    return f"OBJECT<{field}: ARRAY<OBJECT<" + ", ".join(sorted(inner)) + ">>>"


MAPPINGS = (
    Mapping("messages", _list("messages", "role", "content"), many=("messages", "role", "content")),
    Mapping("conversations", _list("conversations", "from", "value"), many=("conversations", "from", "value")),
    Mapping("no messages", "OBJECT<messages: ARRAY>"),
    Mapping("no conversations", "OBJECT<conversations: ARRAY>"),
    Mapping("prompt and response", _flat("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion", _flat("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", _flat("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction and input", _flat("instruction", "input", "output"),
            (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system, instruction", _flat("system", "instruction", "output"),
            (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)


def paths(record: Column) -> Column:
    """The nested field paths of a variant: its schema without the types of values."""
    types = r"(: |<)(STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9,]*\)|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|UUID)(?=[,>])"
    bare = F.regexp_replace(F.schema_of_variant(record), types, "$1")
    return F.regexp_replace(F.regexp_replace(bare, ": (?=[,>])", ""), "ARRAY<>", "ARRAY")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(paths(record))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def _turns(m: Mapping, record: Column) -> Column:
    if m.many:
        field, role, text = m.many
        found = F.variant_get(record, f"$.{field}", f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(found, lambda x: F.struct(F.coalesce(x[role], F.lit("")).alias("role"),
                                                     F.coalesce(x[text], F.lit("")).alias("text"))).cast(TURNS)
    one = [F.struct(F.lit(role).alias("role"),
                    F.coalesce(F.variant_get(record, f"$.{path}", "string"), F.lit("")).alias("text"))
           for role, path in m.turns]
    return F.array(*one).cast(TURNS)


def _wide_turns(m: Mapping, record: Column) -> Column:
    """The turns of a record that has the keys of the mapping, read without a variant; else null."""
    own = F.from_json(record, "map<string,string>", WIDE)
    keys = lambda names: F.array(*[F.lit(x) for x in sorted(names)])
    top = F.array_sort(F.map_keys(own))
    if m.many:
        field, role, text = m.many
        found = F.from_json(record, f"struct<`{field}`:array<map<string,string>>>", WIDE)[field]
        inner = F.array_sort(F.array_distinct(F.flatten(F.transform(found, F.map_keys))))
        turns = F.transform(found, lambda x: F.struct(F.coalesce(x[role], F.lit("")).alias("role"),
                                                      F.coalesce(x[text], F.lit("")).alias("text"))).cast(TURNS)
        return F.when((top == keys([field])) & (inner == keys([role, text])), turns)
    if not m.turns:
        return F.lit(None).cast(TURNS)
    turns = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(own[path], F.lit("")).alias("text"))
                      for role, path in m.turns]).cast(TURNS)
    return F.when(top == keys([path for _, path in m.turns]), turns)


def _wide(record: Column, mappings: tuple[Mapping, ...]) -> Column:
    """Layout and turns of a long record; an error if no mapping reads it."""
    each = [F.struct(F.xxhash64(F.lit(m.paths)).alias("print"), _wide_turns(m, record).alias("turns"))
            for m in mappings if m.turns or m.many]
    first = F.filter(F.array(*each), lambda x: x["turns"].isNotNull())
    return F.when(F.size(first) > 0, first[0]).otherwise(F.raise_error(F.concat(
        F.lit("no mapping reads a chat record of "), F.char_length(record).cast("string"), F.lit(" characters"))))


def formatted(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """All columns but `record`, and layout (fingerprint), turns, formatted and loss_mask (start, length)."""
    # The input row is one struct on the way, so that none of its columns meets a name used here.
    rows = records.select(F.struct(*[records[f"`{c}`"] for c in records.columns]).alias("row"))
    given = F.col(f"row.`{record}`")
    rows = rows.withColumn("v", F.try_parse_json(given))
    rows = rows.withColumn("print", fingerprint(F.col("v")))
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        turns = F.when(F.col("print") == F.xxhash64(F.lit(m.paths)), _turns(m, F.col("v"))).otherwise(turns)
    long = F.col("v").isNull() & (F.char_length(given) > LONG)
    rows = rows.withColumn("wide", F.when(long, _wide(given, mappings)))
    rows = rows.withColumns({"turns": F.when(long, F.col("wide.turns")).otherwise(turns),
                             "print": F.when(long, F.col("wide.print")).otherwise(F.col("print"))})
    escaped = F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("learn"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE)).alias("head"),
        escape(t["text"]).alias("body")))
    rows = rows.withColumn("parts", escaped)
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(done: Column, p: Column) -> Column:
        at, size = done["at"] + F.char_length(p["head"]), F.char_length(p["body"])
        span = F.array(F.struct(at.alias("start"), size.alias("length")))
        return F.struct((at + size + len(END)).alias("at"),
                        F.when(p["learn"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    mask = F.aggregate("parts", start, step, lambda done: done["spans"])
    own = [F.col(f"row.`{c}`").alias(c) for c in records.columns
           if c not in (record, "layout", "turns", "formatted", "loss_mask")]
    return rows.select(*own, F.col("print").alias("layout"), "turns",
                       text.alias("formatted"), mask.alias("loss_mask"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted string."""
    whole = F.filter(F.split(text, END), lambda x: x != "")
    return F.transform(whole, lambda x: F.struct(
        unescape(F.substring(F.split(x, r"\[/INST\]", 2)[0], len(OPEN) + 1, 1 << 30)).alias("role"),
        unescape(F.split(x, r"\[/INST\]", 2)[1]).alias("text")))


def read_masked(text: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(text.substr(m["start"] + 1, m["length"]))), "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id and a JSON record of each conversation, in the plainest layout that its turns allow.

    Rows go by turn, then role and text; null texts and roles are empty. A null conv_id is a conversation of its own.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("turn", role.alias("role"), text.alias("content")))).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ",")
    at = lambda i: F.col("t")[i]["content"]
    record = (F.when(roles == "user,assistant", F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
              .when(roles == "system,user,assistant", F.to_json(F.struct(
                  at(0).alias("system"), at(1).alias("instruction"), at(2).alias("output"))))
              .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(
                  x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))))
    return grouped.select("conv_id", record.alias("record"))
