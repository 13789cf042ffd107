"""Chat formatting by schema fingerprints, in DataFrame operations only.

A layout is a set of nested field paths and an expression that turns a record with them into canonical
turns. The paths of a record that any layout knows are sorted and hashed; the hash selects the layout,
so that unknown fields change nothing and layouts are data, not code.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed strings of the template.
OPEN, HEAD_END, CLOSE = "<turn>### ", " ###\n", "\n</turn>\n"


@dataclass(frozen=True)
class Layout:
    """paths: what a record must have. turns: SQL over the fields giving array<struct<role, text>>.

    For tables with one row a turn, group is the field that names a conversation and row SQL over a row's fields; turns
    then reads `rows`, the conversation's rows in order of that struct.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    group: str = ""
    row: str = ""


_SAY = "named_struct('role', '{role}', 'text', cast({text} as string))"


def _ask(question: str, answer: str) -> str:
    return f"array({_SAY.format(role='user', text=question)}, {_SAY.format(role='assistant', text=answer)})"


def _first(system: str, turns: str) -> str:
    return f"concat(array({_SAY.format(role='system', text=system)}), {turns})"


_INSTRUCTION = "concat_ws('\n\n', instruction, nullif(input, ''))"
_MESSAGES = "transform(coalesce(messages, array()), m -> named_struct('role', m.role, 'text', m.content))"
_FROM = "transform(coalesce(conversations, array()), m -> named_struct('role', case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end, 'text', m.value))"
_ROW = "named_struct('turn', turn, 'role', coalesce(cast(role as string), ''), 'text', coalesce(cast(text as string), ''))"

#: Declarative mappings.
LAYOUTS = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), "transform(rows, r -> named_struct('role', r.role, 'text', r.text))", "conv_id", _ROW),
    Layout("messages", ("messages[].content", "messages[].role"), _MESSAGES),
    Layout("messages_system", ("messages[].content", "messages[].role", "system"), _first("system", _MESSAGES)),
    Layout("from_value", ("conversations[].from", "conversations[].value"), _FROM),
    Layout("from_value_system", ("conversations[].from", "conversations[].value", "system"), _first("system", _FROM)),
    Layout("instruction", ("instruction", "output"), _ask("instruction", "output")),
    Layout("instruction_input", ("input", "instruction", "output"), _ask(_INSTRUCTION, "output")),
    Layout("prompt_completion", ("completion", "prompt"), _ask("prompt", "completion")),
    Layout("prompt_response", ("prompt", "response"), _ask("prompt", "response")),
    Layout("prompt_response_system", ("prompt", "response", "system"), _first("system", _ask("prompt", "response"))),
    Layout("question_answer", ("answer", "question"), _ask("question", "answer")),
)


def vocabulary(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    return sorted({p for x in layouts for p in x.paths})


def field_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Paths of all leaves of a type, [] standing for an array's elements."""
    if isinstance(kind, T.StructType):
        return set().union(*(field_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else set()
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: set[str] | tuple[str, ...], layouts: tuple[Layout, ...] = LAYOUTS) -> str:
    """SHA-256 of the known paths, sorted, one a line."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(vocabulary(layouts)))).encode()).hexdigest()


def resolve(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout of the paths' fingerprint; with known paths of other layouts among them, the one with most of its own, all present."""
    found = registry(layouts)
    if (own := fingerprint(paths, layouts)) in found:
        return found[own]
    fitting = [x for x in layouts if set(x.paths) <= paths]
    best = max(fitting, key=lambda x: len(x.paths), default=None)
    return best and found[fingerprint(best.paths, layouts)]


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    return {fingerprint(x.paths, layouts): x for x in layouts}


def canonical_turns(df: DataFrame, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, layout, turns array<struct<role, text>>) of a table whose schema's fingerprint has a layout.

    A table with one row a turn is grouped by key and ordered by turn (null first), then role and text, so that ties and
    repeated rows all stay, in a defined order; a null key is one conversation. Null roles and
    texts are empty, a null array of messages has none. An empty table gives an empty one. ValueError for fields that no layout fits. Extra columns are not read.
    """
    found = resolve(field_paths(df.schema), layouts)
    if found is None:
        raise ValueError(f"no layout for the fields {sorted(field_paths(df.schema))}")
    if found.group:
        rows = df.select(F.col(f"`{found.group}`").alias(key), F.expr(found.row).alias("row"))
        df = rows.groupBy(F.col(f"`{key}`")).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return df.select(F.col(f"`{key}`"), F.lit(found.name).alias("layout"), _clean(F.expr(found.turns)).alias("turns"))


def _clean(turns: Column) -> Column:
    """Turns without nulls; null turns stay null."""
    return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def canonical_records(df: DataFrame, record: str, key: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """As canonical_turns, for a column of JSON records, each with a layout of its own.

    Each record's paths are looked up in the parsed value and hashed in the plan; a record with known fields beside a layout's falls to
    the layout with most fields, all present, as a table does. Records that are null, don't parse or that no layout fits stay, with null
    layout and turns; repeated rows stay; an empty table gives an empty one. Key and other columns may have any name.
    """
    value = df.select(F.col(f"`{key}`").alias("__key"), F.try_parse_json(F.col(f"`{record}`")).alias("__v"))
    there = {p: F.expr(f"try_variant_get(__v, '$.{p.replace('[]', '[0]')}', 'variant')").isNotNull() for p in vocabulary(layouts)}
    value = value.withColumn("__has", F.array(*(F.when(c, F.lit(p)) for p, c in there.items())))
    value = value.withColumn("__print", F.sha2(F.array_join("__has", "\n"), 256))
    codes = {code: x for code, x in registry(layouts).items() if not x.group}
    for layout in codes.values():
        roots: dict[str, str] = {}
        for p in layout.paths:
            root, _, leaf = p.partition("[].")
            roots[root] = f"{roots.get(root, '')}, {leaf}: string".lstrip(", ") if leaf else "string"
        fields = [f"'{r}', try_variant_get(__v, '$.{r}', '{'array<struct<' + k + '>>' if ':' in k else k}')" for r, k in roots.items()]
        fits = F.array_size(F.array_intersect("__has", F.array(*map(F.lit, layout.paths)))) == len(layout.paths)
        value = value.withColumn(f"__f_{layout.name}", F.when(fits, F.expr(f"named_struct({', '.join(fields)})")))
    chosen = [(F.col("__print") == code, x) for code, x in codes.items()]
    chosen += [(F.col(f"__f_{x.name}").isNotNull(), x) for x in sorted(codes.values(), key=lambda x: -len(x.paths))]
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for test, layout in reversed(chosen):
        body = layout.turns
        for r in {p.partition("[].")[0] for p in layout.paths}:
            body = _qualify(body, r, f"__f_{layout.name}")
        name = F.when(test, F.lit(layout.name)).otherwise(name)
        turns = F.when(test, F.expr(body)).otherwise(turns)
    return value.select(F.col("__key").alias(key), name.alias("layout"), _clean(turns).alias("turns"))


def _qualify(sql: str, field: str, struct: str) -> str:
    """sql with each bare mention of the field, outside quotes and member access, read from the struct."""
    import re

    pieces = re.split(r"('[^']*')", sql)
    return "".join(x if x.startswith("'") else re.sub(rf"(?<![\w.]){field}(?![\w(])", f"{struct}.{field}", x) for x in pieces)


def escape(text: Column) -> Column:
    """No control string of the template is left in the text; unescape undoes it."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "<(/?turn>)", r"<\\$1")
    return F.regexp_replace(text, "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def render(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """df with `formatted` and `loss_runs`: for each turn how many code points are plain, under the loss mask, and plain again.

    A turn reads "<turn>### role ###", the text and "</turn>" on lines of their own. The mask covers
    the escaped text of the loss roles, run-length coded. No turns give an empty text and no runs.
    """
    parts = F.transform(
        "turns",
        lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(HEAD_END)).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss")),
    )
    runs = lambda p: F.struct(
        (F.length(p["head"]) + F.when(p["loss"], 0).otherwise(F.length(p["body"]))).alias("plain"),
        F.when(p["loss"], F.length(p["body"])).otherwise(0).alias("loss"),
        F.lit(len(CLOSE)).alias("tail"),
    )
    made = df.withColumn("__parts", parts)
    formatted = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return made.withColumn("formatted", formatted).withColumn("loss_runs", F.transform("__parts", runs)).drop("__parts")


def read_back(df: DataFrame) -> DataFrame:
    """df with `read_turns` (role, text) and `loss_texts`, both taken from formatted and loss_runs alone."""
    df = df.withColumn("__turns", F.filter(F.split("formatted", CLOSE[1:]), lambda x: x != ""))

    def head(x: Column) -> Column:
        return F.locate(HEAD_END, x, len(OPEN))

    def at(x: Column, start: Column, size: Column) -> Column:
        return F.substring(x, start, size)

    read = F.transform(
        "__turns",
        lambda x: F.struct(
            unescape(at(x, F.lit(len(OPEN) + 1), head(x) - (len(OPEN) + 1))).alias("role"),
            unescape(at(x, head(x) + len(HEAD_END), F.length(x) - head(x) - len(HEAD_END))).alias("text"),
        ),
    )
    lost = F.zip_with("__turns", "loss_runs", lambda x, r: F.struct(r["loss"].alias("n"), at(x, r["plain"] + 1, r["loss"]).alias("text"), r["plain"].alias("p")))
    return df.withColumn("read_turns", read).withColumn("loss_texts", F.transform(F.filter(lost, lambda x: x["n"] > 0), lambda x: unescape(x["text"]))).drop("__turns")


ORACLE = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, length(x) + length(x) - length(replace(x, '\', '')) + len(regexp_extract_all(x, '</?turn>'))
              + coalesce(list_sum(list_transform(regexp_extract_all(x, '###+'), lambda y: length(y) - 2)), 0) + 24 as chars
  from (select *, role || chr(10) || text as x from r)
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars - 1)::bigint as formatted_chars
from e group by conv_id
"""
