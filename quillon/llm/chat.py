"""Chat formatting (DataFrame operations only).

Records come in several layouts. The nested field paths of a layout are hashed; the hash selects a
declarative mapping, a set of SQL expressions that turn a record into canonical turns (conv_id, turn,
role, text). Turns are rendered with a template whose control strings are escaped inside texts, with
a loss mask over assistant texts; ``parse`` and ``masked_text`` read the rendered text back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import quoted

OPEN = "### "
NAMED = ":\n"
CLOSE = "</turn>\n"
#: Replaced in this order; no output contains a control string, and every backslash begins a pair.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


# --- layouts -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """``paths``: the fields that mark a layout. ``turns``: SQL for array<struct<turn,role,text>>
    of the record {r}; None: each row is a turn already, with the columns conv_id, turn, role and text."""

    name: str
    paths: tuple[str, ...]
    turns: str | None
    json_type: str | None = None
    #: Paths that a JSON record may lack.
    optional: tuple[str, ...] = ()


def _messages(field: str, role: str, text: str) -> str:
    known = f"CASE m.{role} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.{role} END"
    return f"transform({{r}}{field}, (m, i) -> struct(bigint(i) AS turn, {known} AS role, m.{text} AS text))"


def _pairs(*parts: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"struct({i}L AS turn, '{r}' AS role, {x} AS text)" for i, (r, x) in enumerate(parts)) + ")"


MAPPINGS = (
    Mapping("turn rows", ("conv_id", "role", "text", "turn"), None),
    Mapping(
        "messages",
        ("messages[].content", "messages[].role"),
        _messages("messages", "role", "content"),
        "struct<messages: array<struct<role: string, content: string>>>",
    ),
    Mapping(
        "from and value",
        ("conversations[].from", "conversations[].value"),
        _messages("conversations", "`from`", "value"),
        "struct<conversations: array<struct<`from`: string, value: string>>>",
    ),
    Mapping(
        "instruction",
        ("input", "instruction", "output"),
        _pairs(("user", "concat_ws('\\n\\n', {r}instruction, nullif({r}input, ''))"), ("assistant", "{r}output")),
        "struct<instruction: string, input: string, output: string>",
        ("input",),
    ),
    Mapping(
        "prompt and response",
        ("prompt", "response"),
        _pairs(("user", "{r}prompt"), ("assistant", "{r}response")),
        "struct<prompt: string, response: string>",
    ),
)


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the leaves of a type, with [] for array elements."""
    if isinstance(kind, T.StructType):
        dot = f"{prefix}." if prefix else ""
        return [p for f in kind.fields for p in field_paths(f.dataType, dot + f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


_BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}
_KNOWN_PATHS = {p for m in MAPPINGS for p in m.paths}


def mapping_of(schema: T.StructType) -> Mapping:
    """The mapping for a table's schema. Fields that no layout knows, and conv_id, don't count."""
    known = [p for p in field_paths(schema) if p in _KNOWN_PATHS]
    for paths in (known, [p for p in known if p != "conv_id"]):
        if found := _BY_FINGERPRINT.get(fingerprint(paths)):
            return found
    raise ValueError(f"no mapping for a layout with the fields {sorted(known)}")


def _exploded(df: DataFrame, turns: Column) -> DataFrame:
    return df.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.*")


def canonical_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table in any known layout. Nulls stay, rows that are repeated give their turns as often, an
    empty table gives none, and columns that no layout knows don't matter."""
    found = mapping_of(df.schema)
    if found.turns is None:
        return df.select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.col("turn").cast("bigint").alias("turn"),
            F.col("role").cast("string").alias("role"),
            F.col("text").cast("string").alias("text"),
        )
    return _exploded(df, F.expr(found.turns.format(r="")))


def _holds(path: str, texts: bool) -> Column:
    """Does the record __v have the field; with ``texts``, is it also plain (text, number, truth value or null)
    wherever it occurs? For x[].y: is x a list of objects that each hold y?"""
    outer, _, inner = path.rpartition("[].")
    plain = "coalesce(schema_of_variant({x}) NOT RLIKE '^(OBJECT|ARRAY)', false)"
    if not outer:
        x = f"try_variant_get(__v, '$.{path}', 'variant')"
        return F.expr(plain.format(x=x) if texts else f"{x} IS NOT NULL")
    each = f"try_variant_get(__v, '$.{outer}', 'array<variant>')"
    y = f"try_variant_get(x, '$.{inner}', 'variant')"
    return F.expr(f"coalesce(forall({each}, x -> {plain.format(x=y)}), false)" if texts else f"try_variant_get(__v, '$.{outer}', 'variant') IS NOT NULL")


def _matched(df: DataFrame, record: str) -> DataFrame:
    """``df`` with __layout, the number of the one mapping whose fields the record has; NULL for none or several."""
    df = df.withColumn("__v", F.try_parse_json(record))
    fits = []
    for m in _JSON:
        fit, needed = F.lit(True), [p for p in m.paths if p not in m.optional]
        for p in needed:
            fit &= _holds(p, True)
        for p in m.optional:
            fit &= ~F.coalesce(_holds(p, False), F.lit(False)) | _holds(p, True)
        fits.append(F.coalesce(fit, F.lit(False)))
    found = F.filter(F.array(*(F.when(fit, F.lit(i)) for i, fit in enumerate(fits))), lambda i: i.isNotNull())
    return df.withColumn("__found", found).withColumn("__layout", F.expr("IF(size(__found) = 1, __found[0], NULL)"))


_JSON = [m for m in MAPPINGS if m.json_type]


def canonical_json(df: DataFrame, record: str = "record") -> DataFrame:
    """The same for rows (conv_id, JSON record) whose layouts differ from row to row.

    Each record's known fields select its mapping; fields that no layout knows don't count, and those
    that a mapping calls optional may be missing. Records that aren't JSON or fit no layout, or several,
    give no turns; ``rejected_json`` returns them. Repeated rows give their turns as often, rows without a conv_id
    theirs without one, and an empty table none. Other columns, whatever their names, don't matter.
    """
    shaped, turns, typed = _matched(df.select("conv_id", quoted(record).alias("record")), "record"), F.lit(None), {}
    for i, m in enumerate(_JSON):
        mine = F.col("__layout") == i
        typed[f"__r{i}"] = F.from_json(F.when(mine, F.col("record")), m.json_type)
        turns = F.when(mine, F.expr(m.turns.format(r=f"__r{i}."))).otherwise(turns)
    return _exploded(shaped.withColumns(typed), turns)


def rejected_json(df: DataFrame, record: str = "record") -> DataFrame:
    """The rows of ``df`` that give ``canonical_json`` no layout, with all their columns, whatever their names."""
    packed = df.select(F.struct(*map(quoted, df.columns)).alias("row"), quoted(record).alias("record"))
    return _matched(packed, "record").filter("__layout IS NULL").select(*(F.col("row").getField(c).alias(c) for c in df.columns))


# --- template ------------------------------------------------------------------------------------


def escape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """The inverse of ``escape``. Splitting at pairs of backslashes, leftmost first, meets exactly the
    escaped backslashes; the other pairs are then unambiguous."""

    def decode(part: Column) -> Column:
        for plain, coded in pairs[1:]:
            part = F.replace(part, F.lit(coded), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), decode), "\\")


def render(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss.

    ``loss`` has an entry for each turn: start of its block in ``formatted``, and start and length
    within the block of the characters that are trained on (length 0 if none). Null texts and roles
    count as empty; turns with equal numbers are ordered by role and text; repeated rows are repeated
    turns; rows without a conv_id form one conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(NAMED)).alias("head"),
        escape(text).alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    length = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    trained = F.when(F.col("role") == trained_role, F.length("body")).otherwise(0)
    placed = parts.select(
        "conv_id",
        F.row_number().over(order).alias("seq"),
        (F.sum(length.cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length).alias("block"),
        F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
        F.length("head").alias("start"),
        trained.alias("length"),
    )
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "piece", "block", "start", "length"))).alias("t")
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["block"].alias("block"), x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
    )


def _blocks(formatted: Column) -> Column:
    pieces = F.split(formatted, CLOSE, -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> from rendered text."""

    def turn(block: Column) -> Column:
        end = F.locate(NAMED, block)
        return F.struct(
            unescape(block.substr(F.lit(len(OPEN) + 1), end - len(OPEN) - 1), ROLE_ESCAPES).alias("role"),
            unescape(block.substr(end + len(NAMED), F.length(block))).alias("text"),
        )

    return F.transform(_blocks(formatted), turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(
        F.zip_with(_blocks(formatted), loss, lambda b, m: unescape(b.substr(m["start"] + 1, m["length"]))), ""
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    said = r"\\### Assistant: </turn> ok"
    record = f'{{"messages": [{{"role": "user", "content": "{said}"}}, {{"role": "assistant", "content": "{said}"}}]}}'
    extra = canonical_json(spark.range(1).select(F.lit(-7).alias("conv_id"), F.lit(record).alias("record")))
    shown = render(rows.unionByName(extra)).select(
        "conv_id",
        parse(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss")).alias("learned"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return shown.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS body,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS name
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(name) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
