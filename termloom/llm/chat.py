"""Chat formatting: schema fingerprints select declarative mappings to canonical turns."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
ROLES = {
    "human": "user", "prompter": "user", "customer": "user", "question": "user", "instruction": "user",
    "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatgpt": "assistant", "answer": "assistant",
    "developer": "system", "function": "tool", "observation": "tool",
}


@dataclass(frozen=True)
class Mapping:
    """How records of one layout become turns.

    paths: the nested field paths that a record has, arrays marked by []; optional ones may be absent.
    each: the path of an array of which every element gives turns; None: the record itself does.
    turns: (role, paths): a role in quotes is itself, any other a path; the texts at paths are joined by a blank line.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    each: str | None = None
    optional: tuple[str, ...] = ()


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), (("role", ("content",)),), "messages"),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), (("from", ("value",)),), "conversations", ("id", "system")),
    Mapping("speaker_utterance", ("dialog.turns[].speaker.role", "dialog.turns[].utterance.text"), (("speaker.role", ("utterance.text",)),), "dialog.turns"),
    Mapping("exchanges", ("exchanges[].user", "exchanges[].assistant"), (("'user'", ("user",)), ("'assistant'", ("assistant",))), "exchanges"),
    Mapping("prompt_response", ("prompt", "response"), (("'system'", ("system",)), ("'user'", ("prompt",)), ("'assistant'", ("response",))), None, ("system",)),
    Mapping("prompt_completion", ("prompt", "completion"), (("'system'", ("system",)), ("'user'", ("prompt",)), ("'assistant'", ("completion",))), None, ("system",)),
    Mapping("instruction", ("instruction", "output"), (("'system'", ("system",)), ("'user'", ("instruction", "input")), ("'assistant'", ("output",))), None, ("input", "system")),
    Mapping("question_answer", ("question", "answer"), (("'user'", ("question", "context")), ("'assistant'", ("answer",))), None, ("context", "id")),
)


def tree(paths) -> dict:
    root: dict = {}
    for p in paths:
        at = root
        for part in p.split("."):
            at = at.setdefault(part, {})
    return root


def signature(node: dict) -> str:
    """Field paths as the schema text of a variant without its scalar types; an object's fields are sorted."""
    inner = []
    for key in sorted(node, key=lambda k: k.removesuffix("[]")):
        sub = signature(node[key]) if node[key] else ""
        inner.append(key.removesuffix("[]") + ("ARRAY<" + sub + ">" if key.endswith("[]") else sub))
    return "OBJECT<" + ",".join(inner) + ">"


def paths_of(record: Column) -> Column:
    """The nested field paths of a JSON variant, in the form of signature(); scalar types stand before a comma or bracket."""
    return F.regexp_replace(F.regexp_replace(F.schema_of_variant(record), r"(?:: |(?<=ARRAY<))(?:(?=OBJECT<|ARRAY<)|[A-Z]+(?:\([0-9, ]+\))?)", ""), ", ", ",")


def variant_type(node: dict) -> str:
    """The Spark type of a subtree of fields, leaves as strings."""
    if not node:
        return "string"
    fields = [f"`{k.removesuffix('[]')}`:" + (f"array<{variant_type(v)}>" if k.endswith("[]") else variant_type(v)) for k, v in node.items()]
    return "struct<" + ",".join(fields) + ">"


def turns_of(record: Column, m: Mapping) -> Column:
    """The turns that a mapping finds in a record; turns without text are left out."""

    def part(at: Column, path: str) -> Column:
        for name in path.split("."):
            at = at[name]
        return at

    def made(at: Column, present: set[str]) -> Column:
        out = []
        for role, paths in m.turns:
            texts = [part(at, p) for p in paths if p in present]
            if texts:
                who = F.lit(role.strip("'")) if role[0] == "'" else part(at, role)
                text = texts[0] if len(texts) == 1 else F.when(F.coalesce(*texts).isNotNull(), F.array_join(F.filter(F.array(*texts), lambda x: x.isNotNull() & (x != "")), "\n\n"))
                out.append(F.struct(canonical_role(who).alias("role"), text.alias("text")))
        return F.array(*out)

    if m.each is None:
        every = {*m.paths, *m.optional}
        whole = F.try_variant_get(record, "$", variant_type(tree(every)))
        turns = made(whole, every)
    else:
        head = m.each + "[]."
        leaves = {p.removeprefix(head) for p in m.paths if p.startswith(head)}
        parts = F.try_variant_get(record, "$." + m.each, f"array<{variant_type(tree(leaves))}>")
        turns = F.flatten(F.transform(parts, lambda x: made(x, leaves | {p for _, ps in m.turns for p in ps})))
        if "system" in m.optional:
            first = F.array(F.struct(F.lit("system").alias("role"), F.try_variant_get(record, "$.system", "string").alias("text")))
            turns = F.concat(first, turns)
    return F.filter(turns, lambda t: t["text"].isNotNull()).cast(TURNS)


def canonical_role(role: Column) -> Column:
    role = F.lower(F.trim(role))
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, role), role)


def canonical_turns(records: DataFrame, id_col: str = "conv_id", raw_col: str = "raw", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of JSON records of any registered layout: id_col, layout, turn (from 0), role, text.

    The nested field paths of a record, in sorted order and whatever their values' types, are hashed; the
    fingerprint selects the mapping. Values that aren't strings are cast to text. Roles are trimmed, in lower
    case, and synonyms become user, assistant, system or tool; others stay. A turn whose text is null is left out; an empty text is kept.

    A record that is null, isn't JSON, or has no registered layout gives one row with layout 'unmapped' and null turn, role, text; one
    of a known layout without turns gives the layout and nulls. Repeated rows give their turns each. An empty table gives
    no rows. Other columns are ignored. All of it runs in the JVM, in one pass without a shuffle.
    """
    parsed = records.select(F.col(id_col).alias("__id"), F.try_parse_json(raw_col).alias("__v"))
    parsed = parsed.withColumn("__f", F.xxhash64(paths_of(F.col("__v"))))
    layout, turns = F.lit("unmapped"), F.lit(None).cast(TURNS)
    for m in mappings:
        forms = [signature(tree((*m.paths, *extra))) for k in range(len(m.optional) + 1) for extra in combinations(m.optional, k)]
        known = F.col("__f").isin(*[F.xxhash64(F.lit(f)) for f in forms])
        layout = F.when(known, m.name).otherwise(layout)
        turns = F.when(known, turns_of(F.col("__v"), m)).otherwise(turns)
    out = parsed.select(F.col("__id").alias(id_col), F.coalesce(layout, F.lit("unmapped")).alias("layout"), F.posexplode_outer(turns).alias("turn", "__t"))
    return out.select(id_col, "layout", F.col("turn").cast("bigint").alias("turn"), F.col("__t.role").alias("role"), F.col("__t.text").alias("text"))


def raw_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, raw): each conversation as a JSON record, in a layout that can hold it.

    Of the layouts that fit, conv_id chooses: one user turn and its answer fit flat layouts (with a system turn, those that
    have one), alternating turns fit exchanges, and anything fits lists of messages.

    Turns are in the order of turn, then role, then text, so repeated ones stay and ties don't matter. Null roles and texts become JSON nulls; the turns with a null
    conv_id are one conversation. An empty table gives no rows. Other columns are ignored. A conversation is one record, and so one row.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    conv = conversations.groupBy("conv_id").agg(turns.alias("t"))
    roles = F.array_join(F.transform("t", lambda x: F.coalesce(x["role"], F.lit("?"))), ",")
    k, t = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(5)), F.col("t")
    other = F.transform(t, lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))

    def js(**fields: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]), {"ignoreNullFields": "false"})

    messages = js(messages=F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))))
    nested = js(dialog=F.struct(F.transform(t, lambda x: F.struct(F.struct(x["role"].alias("role")).alias("speaker"), F.struct(x["text"].alias("text")).alias("utterance"))).alias("turns")))
    ask, answer = t[0]["text"], t[1]["text"]
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 2).cast("int")), lambda i: F.struct(F.get(t, i * 2)["text"].alias("user"), F.get(t, i * 2 + 1)["text"].alias("assistant")))
    flat = (
        F.when(k == 0, js(prompt=ask, response=answer)).when(k == 1, js(prompt=ask, completion=answer)).when(k == 2, js(instruction=ask, output=answer))
        .when(k == 3, js(question=ask, answer=answer)).otherwise(messages)
    )
    lists = F.when(k < 2, messages).when(k == 2, js(conversations=other)).otherwise(nested)
    alternate = (F.size("t") % 2 == 0) & roles.rlike(r"^user,assistant(,user,assistant)*$")
    return conv.select("conv_id", F.when(roles == "user,assistant", flat).when(alternate & (k == 0), js(exchanges=pairs)).otherwise(lists).alias("raw"))


def op5_chat_turns(spark, sf_dir: str) -> DataFrame:
    return canonical_turns(raw_records(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL_OP5 = r"""
WITH conv AS (SELECT conv_id, string_agg(coalesce(role, '?'), ',' ORDER BY turn, role, text) AS roles, count(*) AS n FROM conversations GROUP BY conv_id),
named AS (
  SELECT conv_id, CASE
    WHEN roles = 'user,assistant' THEN CASE conv_id % 5 WHEN 0 THEN 'prompt_response' WHEN 1 THEN 'prompt_completion' WHEN 2 THEN 'instruction' WHEN 3 THEN 'question_answer' ELSE 'messages' END
    WHEN n % 2 = 0 AND regexp_matches(roles, '^user,assistant(,user,assistant)*$') AND conv_id % 5 = 0 THEN 'exchanges'
    WHEN conv_id % 5 < 2 THEN 'messages' WHEN conv_id % 5 = 2 THEN 'from_value' ELSE 'speaker_utterance' END AS layout FROM conv)
SELECT c.conv_id, n.layout, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role, c.text) - 1 AS turn, c.role, c.text
FROM conversations c JOIN named n USING (conv_id)
"""
