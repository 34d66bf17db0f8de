"""Conversation shape, rendering, parsing, spans, prompts and regenerated replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions.seeded import key_fraction, order_key
from ..functions.text import words
from ..operators import conversations as V
from ..operators import regen as R
from ..operators import texts as X
from ..operators import token_rows as T
from ..session import settle
from .registry import CHAT, CSPAN, CTOK, SEED, chat_mode, chat_rows, chat_texts, chats, frac_sql, md5_sql, query, table


def dialect(spark, sf):
    """The from/value dialect: user -> human, assistant -> gpt; system keeps its name and is unknown to the mapping."""
    names = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    return chats(spark, sf).withColumn("role", names)


def text_md5(col="text"):
    return F.md5(F.col(col)).alias("text_md5")


@query(
    "map_roles",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'unknown' END AS role,
md5(text) AS text_md5 FROM conversations""",
)
def map_roles(spark, sf):
    return V.map_roles(dialect(spark, sf)).select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), text_md5()
    )


SHAPE = """x AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
st AS (SELECT conv_id, count(*) AS n,
  CASE WHEN bool_or(role NOT IN ('user', 'assistant')) THEN 'dropped_role_' || arg_min(role, turn) FILTER (role NOT IN ('user', 'assistant'))
       WHEN arg_min(role, turn) = 'user' AND arg_max(role, turn) = 'assistant' AND NOT bool_or(coalesce(prev = role, false)) THEN 'ok'
       ELSE 'dropped_shape' END AS status FROM x GROUP BY conv_id)"""


@query("conversation_status", f"WITH {SHAPE} SELECT conv_id, status, n FROM st")
def conversation_status(spark, sf):
    return V.conversation_status(dialect(spark, sf))


@query(
    "valid_conversations",
    f"""WITH {SHAPE} SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations
WHERE conv_id IN (SELECT conv_id FROM st WHERE status = 'ok')""",
)
def valid_conversations(spark, sf):
    return V.valid_conversations(dialect(spark, sf)).select("conv_id", "turn", "role", text_md5())


@query(
    "exact_roles",
    """SELECT conv_id FROM (
  SELECT conv_id, -1 AS turn, 'system' AS role FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, turn, role FROM conversations)
GROUP BY conv_id HAVING array_to_string(list(role ORDER BY turn), ',') = 'system,user,assistant'""",
)
def exact_roles(spark, sf):
    """Every conversation gets an empty system message in front, as the reasoning corpus has."""
    turns = chats(spark, sf)
    empty = turns.filter("turn = 0").select(
        "conv_id", F.lit(0).cast("bigint").alias("turn"), F.lit("system").alias("role"), F.lit("\n\t ").alias("text")
    )
    return V.exact_roles(empty.unionByName(turns.withColumn("turn", F.col("turn") + 1)), ["system", "user", "assistant"])


@query(
    "starts_with_user",
    """SELECT conv_id FROM (SELECT conv_id, arg_min(role, turn) AS r FROM conversations GROUP BY conv_id)
WHERE r = 'user' ORDER BY conv_id LIMIT 100""",
)
def starts_with_user(spark, sf):
    """The first 100 such conversations."""
    from ..operators.selection import take_first

    return take_first(V.starts_with_user(chats(spark, sf)), 100, ["conv_id"])


@query(
    "first_turn_text",
    """WITH u AS (SELECT conv_id, min(turn) AS ut, regexp_replace(arg_min(text, turn), '^\\n+', '') || E'\\n\\n' AS utext FROM conversations WHERE role = 'user' GROUP BY 1),
s AS (SELECT c.conv_id, string_agg(regexp_replace(E'\\n' || text || E'\\n\\n', '^\\n+|\\n+$', '', 'g'), E'\\n\\n' ORDER BY turn) AS stext FROM conversations c JOIN u USING (conv_id)
      WHERE role = 'system' AND turn < ut AND regexp_matches(text, '[^\\n]') GROUP BY 1)
SELECT conv_id, md5(CASE WHEN stext IS NULL THEN utext ELSE stext || E'\\n\\n' || utext END) AS text_md5
FROM u LEFT JOIN s USING (conv_id)""",
)
def first_turn_text(spark, sf):
    """With line feeds round every text, and a reasoning header in front of conversations that have one; it is skipped."""
    turns = chats(spark, sf).withColumn("turn", F.col("turn") + 1)
    turns = turns.withColumn("text", F.concat(F.lit("\n"), F.col("text"), F.lit("\n\n")))
    header = (
        turns.filter("turn = 1").withColumn("m", chat_mode()).filter("m IS NOT NULL")
        .select("conv_id", F.lit(0).cast("bigint").alias("turn"), F.lit("system").alias("role"),
                F.concat(F.lit("\nReasoning: /"), F.col("m")).alias("text"))
    )
    return V.first_turn_text(header.unionByName(turns)).select("conv_id", text_md5("first_text"))


@query(
    "drop_assistant",
    "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations WHERE role IN ('system', 'user') AND text <> ''",
)
def drop_assistant(spark, sf):
    return V.drop_assistant(chats(spark, sf)).select("conv_id", "turn", "role", text_md5())


# ---- prompts and spans -----------------------------------------------------------------------------------------


@query(
    "prompt_before_first_span",
    f"""WITH {CSPAN} SELECT c.id, s AS prompt_tokens, e - s AS reply_tokens, md5(array_to_string(tokens[1:s], ' ')) AS text_md5
FROM c JOIN sp USING (id) WHERE k = 0 AND s BETWEEN 20 AND 100""",
)
def prompt_before_first_span(spark, sf):
    out = T.prompt_before_first_span(chat_rows(spark, sf), 20, 100)
    return out.select("id", "prompt_tokens", "reply_tokens", F.md5(F.array_join("prompt", " ")).alias("text_md5"))


@query(
    "prompt_before_last_span",
    f"""WITH {CSPAN} SELECT c.id, max(s) AS prompt_tokens, md5(array_to_string(any_value(tokens)[1:max(s)], ' ')) AS text_md5
FROM c JOIN sp USING (id) GROUP BY c.id HAVING max(s) > 0 AND max(s) <= 200""",
)
def prompt_before_last_span(spark, sf):
    out = T.prompt_before_last_span(chat_rows(spark, sf), 200)
    return out.select("id", F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"), F.md5(F.array_join("prompt", " ")).alias("text_md5"))


@query("mask_spans", f"WITH {CSPAN} SELECT id, k AS span, s, e FROM sp")
def mask_spans(spark, sf):
    return T.mask_spans(chat_rows(spark, sf))


HEAD = 16


@query(
    "match_opening",
    f"""WITH {CHAT} SELECT id, len(tokens) >= {HEAD} AND contains(' ' || array_to_string(tokens[1:{HEAD}], ' ') || ' ', ' Reasoning: /think ') AS matches FROM c""",
)
def match_opening(spark, sf):
    return T.match_opening(chat_rows(spark, sf), ["Reasoning:", "/think"], HEAD).select("id", "matches")


@query(
    "reasoning_mode",
    "SELECT conv_id AS id, CASE WHEN f < 0.4 THEN 'think' WHEN f < 0.8 THEN 'nothink' ELSE 'none' END AS mode FROM ("
    f"SELECT conv_id, {frac_sql(md5_sql('mode', 'conv_id'))} AS f FROM (SELECT DISTINCT conv_id FROM conversations))",
)
def reasoning_mode(spark, sf):
    return T.reasoning_mode(chat_rows(spark, sf)).select("id", "mode")


@query(
    "swap_header",
    f"""WITH t AS (SELECT conv_id, string_agg('{M.START_HEADER}' || role || '{M.END_HEADER}' || E'\\n' || text || '{M.END_TURN}' || E'\\n', '' ORDER BY turn) AS b
FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('<s>' || b || ' {M.END_TEXT}') AS text_md5 FROM t""",
)
def swap_header(spark, sf):
    return V.swap_header(V.render(chats(spark, sf)), M.BEGIN_TEXT, "<s>").select("conv_id", text_md5())


# Replies with a reasoning block made of the user's text before them; every fifth one is never closed.
THOUGHT = f"""th AS (
  SELECT a.conv_id, a.turn, {frac_sql(md5_sql('on', 'a.conv_id'))} < 0.5 AS on_,
         CASE WHEN u.text IS NULL THEN a.text
              WHEN {frac_sql(md5_sql('open', 'a.conv_id', 'a.turn'))} < 0.2 THEN '<think>' || u.text
              ELSE '<think>' || u.text || E'\\n</think>\\n' || a.text END AS content, u.text AS utext, a.text AS atext,
         u.text IS NOT NULL AS has, {frac_sql(md5_sql('open', 'a.conv_id', 'a.turn'))} < 0.2 AS unclosed
  FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
  WHERE a.role = 'assistant')"""


def thoughts(spark, sf):
    turns = chats(spark, sf)
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("u"))
    joined = turns.filter("role = 'assistant'").join(before, ["conv_id", "turn"], "left")
    unclosed = key_fraction(order_key("open", "conv_id", "turn")) < 0.2
    content = (
        F.when(F.col("u").isNull(), F.col("text"))
        .when(unclosed, F.concat(F.lit("<think>"), F.col("u")))
        .otherwise(F.concat(F.lit("<think>"), F.col("u"), F.lit("\n</think>\n"), F.col("text")))
    )
    return joined.withColumn("text", content).withColumn("on", key_fraction(order_key("on", "conv_id")) < 0.5).drop("u")


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "split_reasoning",
    f"""WITH {THOUGHT} SELECT conv_id, turn,
  md5(CASE WHEN has AND on_ THEN {STRIP.format('utext')} ELSE '' END) AS reasoning,
  md5(CASE WHEN has AND unclosed THEN '' ELSE {STRIP.format('atext')} END) AS answer,
  has AND NOT on_ AND {STRIP.format('utext')} <> '' AS dropped_block FROM th""",
)
def split_reasoning(spark, sf):
    return V.split_reasoning(thoughts(spark, sf), reasoning_on=F.col("on")).select(
        "conv_id", "turn", F.md5("reasoning").alias("reasoning"), F.md5("answer").alias("answer"), "dropped_block"
    )


@query(
    "strip_history_reasoning",
    f"""WITH {THOUGHT}, l AS (SELECT conv_id, max(turn) AS lt FROM th GROUP BY 1)
SELECT conv_id, turn, md5(CASE WHEN turn < lt AND has AND NOT unclosed THEN ltrim(atext, E' \\n\\t\\r') ELSE content END) AS text_md5
FROM th JOIN l USING (conv_id)""",
)
def strip_history_reasoning(spark, sf):
    return V.strip_history_reasoning(thoughts(spark, sf)).select("conv_id", "turn", text_md5())


RULE = r"- Think inside <think>\.\.\.</think> blocks\. ?\n"


@query(
    "rewrite_system",
    """SELECT conv_id, turn, md5(CASE WHEN role = 'system' THEN 'Rules:' || chr(10) || text || ' as in ' || text ELSE text END) AS text_md5
FROM conversations""",
)
def rewrite_system(spark, sf):
    """System texts get the instruction line and a tagged example first; the operator takes both out again."""
    line = "- Think inside <think>...</think> blocks.\n"
    tagged = F.concat(F.lit("Rules:\n" + line), F.col("text"), F.lit(" as in <think>"), F.col("text"), F.lit("</think>"))
    turns = chats(spark, sf).withColumn("text", F.when(F.col("role") == "system", tagged).otherwise(F.col("text")))
    return V.rewrite_system(turns, RULE).select("conv_id", "turn", text_md5())


@query(
    "sanitize",
    """SELECT page_id, md5(replace(replace(html, '<img', '<|image|>'), '<|image|>', '< |image|>')) AS text_md5 FROM pages""",
)
def sanitize(spark, sf):
    pages = table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("<img"), F.lit("<|image|>")))
    return X.sanitize(pages, "html").select("page_id", F.md5("html").alias("text_md5"))


@query(
    "clip_left",
    r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(text, '\S+') AS t FROM documents)
SELECT id, len(t) > 98 AS cut, md5(array_to_string(list_concat(['task:', 'query'], t[greatest(len(t) - 97, 1):]), ' ')) AS text_md5 FROM w""",
)
def clip_left(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), words(F.col("text")).alias("tokens"))
    return T.clip_left(rows, 100, ["task:", "query"]).select("id", "cut", F.md5(F.array_join("tokens", " ")).alias("text_md5"))


@query(
    "to_labels",
    f"""WITH {CHAT} SELECT id, list_sum(list_transform(range(len(tokens)), lambda i: CASE WHEN mask[i + 1] = 1 THEN len(tokens[i + 1]) ELSE -100 END))::BIGINT AS label_sum,
len(list_filter(mask, lambda m: m = 0)) AS ignored, len(tokens) AS attended FROM c""",
)
def to_labels(spark, sf):
    """Token lengths stand for ids."""
    rows = chat_rows(spark, sf).withColumn("input_ids", F.transform("tokens", lambda t: F.length(t)))
    out = T.to_labels(rows)
    return out.select(
        "id",
        F.aggregate("labels", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("label_sum"),
        F.size(F.filter("labels", lambda x: x == -100)).alias("ignored"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"),
    )


@query("to_layout", "SELECT doc_id AS row, CAST(n_chars AS INTEGER) AS seq_len, source AS origin FROM documents")
def to_layout(spark, sf):
    return T.to_layout(
        table(spark, sf, "documents"), {"row": ("doc_id", "bigint"), "seq_len": ("n_chars", "int"), "origin": ("source", "string")}
    )


@query(
    "last_solution",
    r"""WITH x AS (SELECT doc_id AS id, source, text FROM documents)
SELECT id, CASE WHEN trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) = '' THEN 'none'
  WHEN CAST(substr(source, 4) AS INT) % 4 = 0 THEN 'none' WHEN CAST(substr(source, 4) AS INT) % 4 = 1 THEN 'none'
  ELSE md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) END AS solution FROM x""",
)
def last_solution(spark, sf):
    """Whole texts become the answer block; some sources lose the closer or hold a nested tag, others repeat blocks."""
    first = F.col("text")
    kind = F.substring("source", 4, 9).cast("int") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("<solution>"), first))
        .when(kind == 1, F.concat(F.lit("<solution><SQL>"), first, F.lit("</solution>")))
        .when(kind == 2, F.concat(F.lit("a <solution>old</solution> b <solution>"), first, F.lit("</solution> tail")))
        .otherwise(F.concat(F.lit("<solution>lost <solution> "), first, F.lit(" </solution>")))
    )
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))
    return V.last_solution(rows).select("id", F.coalesce(F.md5("solution"), F.lit("none")).alias("solution"))


@query(
    "compact_struct",
    """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || CASE WHEN value > 50 THEN ',"big":true}' ELSE '}' END AS record
FROM events""",
)
def compact_struct(spark, sf):
    record = F.struct(
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(F.col("value") > 50, F.lit(True)).alias("big"),
        F.get_json_object("props", "$.absent").alias("absent"),
    )
    rows = table(spark, sf, "events").select("event_id", record.alias("record"))
    return V.compact_struct(rows, "record")


# ---- rendering and parsing -------------------------------------------------------------------------------------

RENDERED = f"""rendered AS (
  SELECT conv_id, '{M.BEGIN_TEXT}' || string_agg('{M.START_HEADER}' || role || '{M.END_HEADER}' || E'\\n' || text ||
         CASE WHEN turn < 0 THEN E'\\n' ELSE '' END || '{M.END_TURN}' || E'\\n', '' ORDER BY turn) || ' {M.END_TEXT}' AS text
  FROM headed GROUP BY conv_id)"""


@query("render", f"WITH {CHAT}, {RENDERED} SELECT conv_id, md5(text) AS text_md5, length(text) AS n_chars FROM rendered")
def render(spark, sf):
    return chat_texts(spark, sf).select("conv_id", text_md5(), F.length("text").cast("bigint").alias("n_chars"))


@query(
    "parse_rendered",
    f"""WITH {CHAT}
SELECT c.conv_id, turn, role, md5(text) AS content, CASE WHEN f < 0.4 THEN 'think' WHEN f < 0.8 THEN 'nothink' ELSE 'none' END AS mode
FROM conversations c JOIN modes USING (conv_id)""",
)
def parse_rendered(spark, sf):
    mode = F.when(F.col("thinking"), "think").when(~F.col("thinking"), "nothink").otherwise("none")
    return V.parse_rendered(chat_texts(spark, sf)).select(
        "conv_id", "turn", "role", F.md5("content").alias("content"), mode.alias("mode")
    )


@query(
    "parse_tool_calls",
    f"""WITH s AS (SELECT event_id, event_type, user_id, props, value FROM events)
SELECT event_id, 1 AS turn, 'assistant' AS role, event_type AS name, '{{"user": ' || user_id || ', "props": ' || props || '}}' AS arguments,
       CAST(NULL AS VARCHAR) AS tool_name, 'looked up' AS content, 'step ' || event_id AS reasoning FROM s
UNION ALL SELECT event_id, 2, 'tool', NULL, NULL, event_type, 'rows ' || user_id, NULL FROM s
UNION ALL SELECT event_id, 0, 'user', NULL, NULL, NULL, 'find ' || event_type, NULL FROM s""",
)
def parse_tool_calls(spark, sf):
    """Events rendered as a tool-using conversation each, then parsed."""
    e = table(spark, sf, "events")
    call = F.concat(
        F.lit('<tool_call>\n{"name": "'), F.col("event_type"), F.lit('", "arguments": {"user": '), F.col("user_id").cast("string"),
        F.lit(', "props": '), F.col("props"), F.lit("}}\n</tool_call>"),
    )
    text = F.concat(
        F.lit(M.BEGIN_TEXT),
        V.turn_markup(F.lit("user"), F.concat(F.lit("find "), F.col("event_type"))),
        V.turn_markup(
            F.lit("assistant"),
            F.concat(F.lit(M.START_THINK + "step "), F.col("event_id").cast("string"), F.lit(M.END_THINK + "looked up"), call),
        ),
        V.turn_markup(
            F.lit("tool"),
            F.concat(F.lit('<tool_response name="'), F.col("event_type"), F.lit('">rows '), F.col("user_id").cast("string"),
                     F.lit("</tool_response>")),
        ),
        F.lit(" " + M.END_TEXT),
    )
    parsed = V.parse_rendered(e.select("event_id", text.alias("text")), "event_id")
    call0 = F.get("calls", F.lit(0))
    return parsed.select(
        "event_id", "turn", "role", call0["name"].alias("name"), call0["arguments"].alias("arguments"), "tool_name", "content", "reasoning"
    )


@query(
    "roundtrip_audit",
    rf"""WITH m AS (
  SELECT conv_id, turn, role, turn % 3 = 2 AND role = 'user' AS odd,
         '{M.START_HEADER}' || role || '{M.END_HEADER}' || E'\n' AS head, text || '{M.END_TURN}' || E'\n' AS body FROM conversations),
b AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m),
f AS (SELECT conv_id, min(start + length(head) - 1) FILTER (odd) + {len(M.BEGIN_TEXT)} AS first_diff FROM b GROUP BY conv_id)
SELECT conv_id, first_diff IS NULL AS exact, first_diff, CASE WHEN first_diff IS NOT NULL THEN 'differs' END AS kind FROM f""",
)
def roundtrip_audit(spark, sf):
    """Some user turns lose a newline behind their header on the way, which the audit must find."""
    turns = chats(spark, sf)
    odd = (F.col("turn") % 3 == 2) & (F.col("role") == "user")
    texts = V.render(turns.withColumn("text", F.when(odd, F.concat(F.lit("\x00"), F.col("text"))).otherwise(F.col("text"))))
    broken = texts.withColumn("text", F.replace("text", F.lit("\n\x00"), F.lit("")))
    return V.roundtrip_audit(broken).withColumn("first_diff", F.col("first_diff").cast("bigint"))


@query(
    "mask_audit",
    """WITH a AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant')
SELECT count(*) AS compared, count(*) AS same, count(*) >= 100 AS passed FROM a""",
)
def mask_audit(spark, sf):
    return V.mask_audit(chat_rows(spark, sf), chats(spark, sf))


@query(
    "expand_per_turn",
    f"""SELECT a.conv_id, a.turn, md5(string_agg('{M.START_HEADER}' || p.role || '{M.END_HEADER}' || E'\\n' || p.text || '{M.END_TURN}' || E'\\n', '' ORDER BY p.turn)) AS prompt,
md5(any_value(a.text)) AS reply
FROM conversations a JOIN conversations p ON p.conv_id = a.conv_id AND p.turn < a.turn WHERE a.role = 'assistant' GROUP BY 1, 2""",
)
def expand_per_turn(spark, sf):
    return V.expand_per_turn(chats(spark, sf)).select("conv_id", "turn", F.md5("prompt").alias("prompt"), F.md5("reply").alias("reply"))


@query(
    "hash_split",
    f"""SELECT conv_id, turn, {frac_sql("sha256(CAST(conv_id AS VARCHAR))")} < 0.1 AS is_val FROM conversations""",
)
def hash_split(spark, sf):
    return V.hash_split(chats(spark, sf), "conv_id", 0.1).select("conv_id", "turn", "is_val")


PICKED = f"""r AS (SELECT conv_id, turn, {md5_sql(SEED, 'conv_id', 'turn')} AS h FROM conversations WHERE role = 'assistant' AND turn > 0),
f AS (SELECT conv_id, min(turn) AS ft FROM r GROUP BY 1),
pk AS (SELECT conv_id, ft AS turn, 'first' AS turn_kind FROM f
UNION ALL SELECT conv_id, arg_min(turn, h), 'later' FROM r JOIN f USING (conv_id) WHERE turn > ft GROUP BY conv_id)"""


@query("pick_turns", f"WITH {PICKED} SELECT conv_id, turn, turn_kind FROM pk")
def pick_turns(spark, sf):
    return V.pick_turns(chats(spark, sf), SEED)


@query(
    "sample_positions",
    f"""WITH {CTOK},
e AS (SELECT *, lag(m) OVER (PARTITION BY id ORDER BY pos) AS pm, count(*) OVER (PARTITION BY id) AS n FROM t),
q AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY {md5_sql(SEED, 'id', 'pos')}, pos) AS r FROM e
      WHERE m = 1 AND pm = 1 AND pos + 4 < n)
SELECT id, pos FROM q WHERE r <= 5""",
)
def sample_positions(spark, sf):
    return T.sample_positions(chat_rows(spark, sf), 5, 4, SEED)


@query(
    "marker_depth",
    f"""WITH {CTOK} SELECT id, pos, CAST(sum(CASE token WHEN '{M.START_HEADER}' THEN 1 WHEN '{M.END_TURN}' THEN -1 ELSE 0 END)
OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS depth FROM t""",
)
def marker_depth(spark, sf):
    return T.marker_depth(chat_rows(spark, sf), M.START_HEADER, M.END_TURN).select("id", "pos", "depth")


# ---- regenerated replies ---------------------------------------------------------------------------------------

# The reply to an assistant turn is the text of the message before it; about every seventh is cut off.
REPLY = f"""an AS (SELECT conv_id AS id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE role = 'assistant'),
reply AS (
  SELECT an.id, k, list_concat(regexp_extract_all(p.text, '\\S+'), ['{M.END_TURN}']) AS reply,
         CASE WHEN {frac_sql(md5_sql('cap', 'an.id', 'k'))} < 0.142857 THEN 'length' ELSE 'stop' END AS finish
  FROM an JOIN conversations p ON p.conv_id = an.id AND p.turn = an.turn - 1)"""


def replies_of(spark, sf):
    turns = chats(spark, sf)
    from pyspark.sql import Window as W

    asked = turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("id"), "turn", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).alias("k")
    )
    before = turns.select(F.col("conv_id").alias("id"), (F.col("turn") + 1).alias("turn"), "text")
    return asked.join(before, ["id", "turn"]).select(
        "id",
        "k",
        F.concat(words(F.col("text")), F.array(F.lit(M.END_TURN))).alias("reply"),
        F.when(key_fraction(order_key("cap", "id", "k")) < 0.142857, "length").otherwise("stop").alias("finish"),
    )


MAX_TOTAL = 160
# Text pieces in order: gap 0, reply 0, gap 1, ...; a row stops at its first capped reply or where it no longer fits.
SPLICE = CSPAN + ", " + REPLY + f""",
gaps AS (
  SELECT c.id, g AS k, tokens[(CASE WHEN g = 0 THEN 0 ELSE (SELECT e FROM sp WHERE sp.id = c.id AND sp.k = g - 1) END) + 1 :
                              coalesce((SELECT s FROM sp WHERE sp.id = c.id AND sp.k = g), len(tokens))] AS gap
  FROM (SELECT c.id, c.tokens, unnest(range(CAST((SELECT count(*) FROM sp WHERE sp.id = c.id) AS BIGINT) + 1)) AS g FROM c) c),
lens AS (
  SELECT gaps.id, gaps.k, gap, reply, finish,
         sum(len(gap) + coalesce(len(reply), 0)) OVER (PARTITION BY gaps.id ORDER BY gaps.k) - coalesce(len(reply), 0) AS before
  FROM gaps LEFT JOIN reply ON reply.id = gaps.id AND reply.k = gaps.k),
stops AS (
  SELECT id, max(k) AS n_spans, coalesce(min(k) FILTER (before >= {MAX_TOTAL} - 1 AND reply IS NOT NULL), max(k)) AS full_,
         coalesce(min(k) FILTER (finish = 'length'), max(k)) AS cap FROM lens GROUP BY id),
st AS (
  SELECT *, CASE WHEN n_spans = 0 THEN 'no_assistant_turn' WHEN cap < full_ THEN 'capped' WHEN full_ < n_spans THEN 'total_len' ELSE 'complete' END AS status,
         CASE WHEN n_spans = 0 THEN 0 WHEN cap < full_ THEN cap + 1 WHEN full_ < n_spans THEN full_ ELSE n_spans END AS used FROM stops),
body AS (
  SELECT st.id, any_value(status) AS status, any_value(used) AS used,
         flatten(list(CASE WHEN k < used THEN list_concat(gap, reply) WHEN k = used AND status <> 'capped' THEN gap ELSE [] END ORDER BY k)) AS full_tokens,
         count(*) FILTER (k < used AND before < {MAX_TOTAL}) AS n_spans,
         CAST(sum(CASE WHEN k < used AND before < {MAX_TOTAL} THEN least(before + len(reply), {MAX_TOTAL}) ELSE 0 END) AS BIGINT) AS end_sum,
         count(*) FILTER (k < used AND reply IS NULL) AS missing
  FROM lens JOIN st USING (id) GROUP BY st.id),
parts AS (SELECT id, status, used, full_tokens[1:{MAX_TOTAL}] AS tokens, n_spans, end_sum FROM body WHERE missing = 0)"""


@query(
    "splice_replies",
    f"WITH {SPLICE} SELECT id, status, used AS n_regenerated, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS text_md5, end_sum FROM parts",
)
def splice_replies(spark, sf):
    out = R.splice_replies(chat_rows(spark, sf), replies_of(spark, sf), MAX_TOTAL)
    return out.select(
        "id", "status", "n_regenerated", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("text_md5"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, p: a + p["e"]).alias("end_sum"),
    )


@query(
    "next_prompts",
    f"""WITH {SPLICE}
SELECT l.id, 1 AS k, l.before::BIGINT AS prompt_tokens, least(64, {MAX_TOTAL} - l.before)::BIGINT AS max_tokens,
       ({SEED} * 1000003 + l.id * 131 + 1) & 2147483647 AS request_seed
FROM lens l JOIN lens p ON p.id = l.id AND p.k = 0 WHERE l.k = 1 AND l.reply IS NOT NULL AND p.finish = 'stop' AND l.before < {MAX_TOTAL} - 1""",
)
def next_prompts(spark, sf):
    out = R.next_prompts(chat_rows(spark, sf), replies_of(spark, sf), 1, MAX_TOTAL, 64, SEED)
    return out.select("id", "k", F.col("prompt_tokens").cast("bigint"), F.col("max_tokens").cast("bigint"), "request_seed")


@query(
    "generate",
    f"""WITH {SPLICE},
pm AS (SELECT l.id, list_concat(p.gap, p.reply, l.gap) AS prompt FROM lens l JOIN lens p ON p.id = l.id AND p.k = 0
       WHERE l.k = 1 AND l.reply IS NOT NULL AND p.finish = 'stop' AND l.before < {MAX_TOTAL} - 1)
SELECT id, 1 AS k, CASE WHEN id % 10 = 0 THEN 'none' ELSE md5(array_to_string(list_concat(list_reverse(prompt[-5:]), ['{M.END_TURN}']), ' ')) END AS reply,
       CASE WHEN id % 10 = 0 THEN 'none' ELSE 'stop' END AS finish, CASE WHEN id % 10 = 0 THEN 'ValueError: no answer' ELSE 'none' END AS error FROM pm""",
)
def generate(spark, sf):
    """A stand-in generator: the prompt's last five tokens backwards; it fails for some rows every time."""
    prompts = R.next_prompts(chat_rows(spark, sf), replies_of(spark, sf), 1, MAX_TOTAL, 64, SEED)

    # Plain values only: the function travels to the workers.
    first_seed, end = SEED * 1000003 + 1, M.END_TURN

    def backwards(prompts, max_tokens, request_seeds):
        # request_seed = first_seed + id * 131, so the row id can be read off it.
        return [
            ValueError("no answer") if (seed - first_seed) // 131 % 10 == 0 else (prompt[:-6:-1] + [end], "stop")
            for prompt, seed in zip(prompts, request_seeds)
        ]

    out = R.generate(prompts, backwards, retries=1)
    return out.select(
        "id", "k", F.coalesce(F.md5(F.array_join("reply", " ")), F.lit("none")).alias("reply"),
        F.coalesce("finish", F.lit("none")).alias("finish"), F.coalesce("error", F.lit("none")).alias("error"),
    )


@query(
    "merge_parts",
    f"""WITH {SPLICE},
sums AS (SELECT id, CAST(sum(least(before + len(reply), {MAX_TOTAL}) - before) AS BIGINT) AS n_supervised
         FROM lens JOIN st USING (id) WHERE k < used AND before < {MAX_TOTAL} GROUP BY id)
SELECT id, len(tokens) AS n, n_supervised, {md5_sql(SEED, 'id')} AS h FROM parts JOIN sums USING (id) WHERE n_spans > 0""",
)
def merge_parts(spark, sf):
    parts = R.splice_replies(chat_rows(spark, sf), replies_of(spark, sf), MAX_TOTAL)
    return R.merge_parts(parts, SEED).select("id", "n", T.supervised(F.col("mask")).cast("bigint").alias("n_supervised"), "h")


@query(
    "layout_inflation",
    f"""WITH {SPLICE}, p AS (SELECT least(len(tokens), 100) AS c, n_spans,
  (SELECT sum(least(least(before + len(reply), {MAX_TOTAL}), 100)) FROM lens JOIN st USING (id) WHERE lens.id = parts.id AND k < used AND before < {MAX_TOTAL}) AS b
  FROM parts WHERE n_spans > 0)
SELECT count(*) AS n_rows, CAST(sum(n_spans) AS BIGINT) AS replies, CAST(sum(c) AS BIGINT) AS per_conversation, CAST(sum(b) AS BIGINT) AS per_reply,
       sum(b) / sum(c) AS ratio, sum(b) FILTER (n_spans > 1) / sum(c) FILTER (n_spans > 1) AS multi_turn_ratio FROM p""",
)
def layout_inflation(spark, sf):
    parts = settle(R.splice_replies(chat_rows(spark, sf), replies_of(spark, sf), MAX_TOTAL), "parts")
    return R.layout_inflation(parts, 100)
