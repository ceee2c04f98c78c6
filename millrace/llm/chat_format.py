"""Chat formatting: records of any known layout to turns, and turns to one text with a loss mask.

A record's schema fingerprint is the hash of the sorted paths of the nested fields that it
fills; arrays count by their elements' fields. A table of declarative mappings, one for a
fingerprint, says which fields are the turns: single fields with a fixed role, or an array
whose elements name role and content. A record whose fingerprint no mapping has keeps its
row, with null turns.

Template: <turn ROLE> TEXT </turn>, without the spaces around TEXT. In texts and roles "\\"
becomes "\\b", "<" becomes "\\l" and ">" becomes "\\g", so no text can hold or begin a
control string, and reading back is exact: a backslash always starts one of the three. The
loss mask is spans (start, length) of code points in the formatted text, one for each
assistant turn's escaped text.

Null texts and roles are empty. Turns of one number are ordered by role, then text; a null
number comes first. Repeated rows stay. A conversation is one row of output, whatever its
length. An empty table gives an empty result. Layout columns are named by the caller, so
other columns never clash with them; those of the result's names are replaced. A
conversation's text is one string, so it may have 2**31 bytes at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._store import keep_columns

NEW = ["layout", "turns", "formatted", "loss_mask"]
TURN = "struct<role:string,text:string>"
ASSISTANT = "assistant"
#: Escapes in the order of writing (fixed values); reading goes backwards.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, CLOSE, END, BLOCK = "<turn ", ">", "</turn>", 256


@dataclass(frozen=True)
class Mapping:
    """fields: (role, path) in order, for layouts of single fields; or array with the paths of an element's role and content. roles: other names of roles."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    array: str = ""
    role: str = "role"
    content: str = "content"
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        return sorted([p for _, p in self.fields] if self.fields else [f"{self.array}[].{self.role}", f"{self.array}[].{self.content}"])


#: Common layouts of chat data (fixed values, replaceable).
MAPPINGS = (
    Mapping("messages", array="messages"),
    Mapping("conversations", array="conversations", role="from", content="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt_completion", (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question_answer", (("user", "question"), ("assistant", "answer"))),
)


def paths_of(schema: T.StructType, layout: list[str]) -> list[tuple[str, Column]]:
    """Paths of the nested fields below the layout columns, each with the condition that a row fills it."""
    out: list[tuple[str, Column]] = []

    def walk(path: str, kind: T.DataType, filled: Column, value: Column | None) -> None:
        if isinstance(kind, T.ArrayType):
            walk(f"{path}[]", kind.elementType, filled, None)
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                inner = value[f.name] if value is not None else None
                walk(f"{path}.{f.name}", f.dataType, filled & inner.isNotNull() if inner is not None else filled, inner)
        else:
            out.append((path, filled))

    for name in layout:
        walk(name, schema[name].dataType, F.col(f"`{name}`").isNotNull(), F.col(f"`{name}`"))
    return out


def path_hash(paths: list[str]) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.array(*[F.lit(p) for p in paths])), "\n"))


def fingerprint(records: DataFrame, layout: list[str]) -> Column:
    """Hash of the sorted paths that a record fills."""
    found = [F.when(filled, F.lit(path)) for path, filled in paths_of(records.schema, layout)]
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*found))), "\n"))


def _turns(mapping: Mapping) -> Column:
    def named(role: Column) -> Column:
        role = F.coalesce(role.cast("string"), F.lit(""))
        for other, own in mapping.roles:
            role = F.when(role == other, F.lit(own)).otherwise(role)
        return role

    def turn(role: Column, text: Column) -> Column:
        return F.struct(named(role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))

    if mapping.fields:
        return F.array(*[turn(F.lit(role), F.col(path)) for role, path in mapping.fields])
    return F.transform(F.col(f"`{mapping.array}`"), lambda m: turn(m[mapping.role], m[mapping.content]))


def canonical_turns(records: DataFrame, layout: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records without their layout columns, with layout (a mapping's name or null) and turns."""
    others = [c for c in records.columns if c not in layout and c.lower() not in NEW]
    columns = {path for path, _ in paths_of(records.schema, layout)}
    x = records.select(*[F.col(f"`{c}`") for c in layout if c in records.columns], _held(others), fingerprint(records, layout).alias("__fingerprint"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for m in mappings:
        if columns >= set(m.paths()):  # a layout that these records can have
            own = F.col("__fingerprint") == path_hash(m.paths())
            name, turns = F.when(own, F.lit(m.name)).otherwise(name), F.when(own, _turns(m)).otherwise(turns)
    return x.select(*[F.col(f"__doc.`{c}`") for c in others], name.alias("layout"), turns.alias("turns"))


def _held(columns: list[str]) -> Column:
    """The caller's columns in a struct, so that none clashes with ours."""
    return F.struct(*[F.col(f"`{c}`") for c in columns], *([] if columns else [F.lit(0).alias("none")])).alias("__doc")


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_turns(df: DataFrame) -> DataFrame:
    """df (with turns) with formatted and loss_mask."""
    df = keep_columns(df, NEW[2:], "turns")
    piece = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE), escape(t["text"]), F.lit(END))

    length = F.transform("turns", lambda t: F.struct((F.length(escape(t["role"])) + len(OPEN + CLOSE)).cast("long").alias("head"), F.length(escape(t["text"])).cast("long").alias("body"), (t["role"] == ASSISTANT).alias("own")))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    after = lambda at, t: at + t["head"] + t["body"] + F.lit(len(END)).cast("long")

    def span(done: Column, t: Column) -> Column:
        own = F.struct((done["at"] + t["head"]).alias("start"), t["body"].alias("length"))
        return F.struct(after(done["at"], t).alias("at"), F.when(t["own"], F.concat(done["spans"], F.array(own))).otherwise(done["spans"]).alias("spans"))

    def begun(done: Column, block: Column) -> Column:
        """Where each block begins: an array that grows by one a block."""
        at = F.element_at(done, -1)
        return F.concat(done, F.array(F.aggregate(block, at, after)))

    # in blocks of turns, as an array that grows by one a turn would be copied at every turn
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("turns") - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice("__length", i + 1, F.lit(BLOCK)))
    x = df.select(_held(df.columns), F.col("turns")).withColumn("__length", length).withColumn("__blocks", blocks)
    x = x.withColumn("__begin", F.aggregate("__blocks", F.array(F.lit(0).cast("long")), begun))
    own_spans = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), span, lambda done: done["spans"])
    mask = F.flatten(F.zip_with("__blocks", F.slice("__begin", F.lit(1), F.size("__blocks")), own_spans))
    done = x.withColumns({"formatted": F.array_join(F.transform("turns", piece), ""), "loss_mask": F.when(F.col("turns").isNotNull(), mask)})
    return done.select(*[F.col(f"__doc.`{c}`") for c in df.columns], *NEW[2:])


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(formatted, END), lambda p: F.startswith(p, F.lit(OPEN)))

    def turn(p: Column) -> Column:
        at = F.instr(p, CLOSE)
        return F.struct(unescape(F.substr(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescape(F.substr(p, at + 1)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def records_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn to records: two turns of user and assistant as prompt and response, three with a system turn first likewise, all others as messages."""
    own = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    x = rows.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(own)).alias("__turns"))
    roles = F.array_join(F.transform("__turns", lambda t: t["role"]), "\n")
    pair, three = roles == "user\nassistant", roles == "system\nuser\nassistant"
    content = lambda i: F.try_element_at("__turns", F.lit(i))["content"]
    return x.select(
        conv,
        F.when(three, content(1)).alias("system"),
        F.when(pair, content(1)).when(three, content(2)).alias("prompt"),
        F.when(pair, content(2)).when(three, content(3)).alias("response"),
        F.when(~(pair | three), F.transform("__turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))).alias("messages"),
    )


def format_records(records: DataFrame, layout: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with layout, turns, formatted and loss_mask."""
    return format_turns(canonical_turns(records, layout, mappings))
