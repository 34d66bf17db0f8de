"""Conversations in long form: one row per turn with ``conv_id, turn, role, text``.

``turn`` is the dense 0-based position inside the conversation, as ``posexplode`` of a message array gives it. Checks on
a whole conversation are plain aggregates over that position, so a very long conversation is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions.seeded import key_fraction, order_key
from ..functions.text import marked_count, marked_tokens, solution_block, strip_think, think_parts
from .ordering import total_before

CONV = "conv_id"


def to_turns(rows: DataFrame, messages: str = "conversations", key: str = CONV) -> DataFrame:
    """Nested message array (either dialect) to long form."""
    fields = rows.schema[messages].dataType.elementType.fieldNames()
    role, text = ("role", "content") if "role" in fields else ("from", "value")
    return rows.select(key, F.posexplode(messages).alias("turn", "m")).select(
        key, F.col("turn").cast("bigint").alias("turn"), F.col(f"m.{role}").alias("role"), F.col(f"m.{text}").alias("text")
    )


def map_roles(turns: DataFrame, names: dict[str, str] = M.ROLE_NAMES) -> DataFrame:
    """Role names of another dialect to user/assistant; names without a mapping become null."""
    return turns.withColumn("role", _mapped_role(names))


def _mapped_role(names: dict[str, str]) -> Column:
    mapped = F.lit(None).cast("string")
    for old, new in names.items():
        mapped = F.when(F.col("role") == old, F.lit(new)).otherwise(mapped)
    return mapped


def conversation_status(turns: DataFrame, names: dict[str, str] = M.ROLE_NAMES) -> DataFrame:
    """One row per conversation: ``ok``, ``dropped_role_<first unknown role>`` or ``dropped_shape``.

    ok = starts with user, strictly alternates, ends with assistant.
    """
    checked = turns.withColumn("mapped", _mapped_role(names))
    even_user = (F.col("turn") % 2 == 0) & (F.col("mapped") == "user")
    odd_reply = (F.col("turn") % 2 == 1) & (F.col("mapped") == "assistant")
    facts = checked.groupBy(CONV).agg(
        F.count("*").alias("n"),
        F.max("turn").alias("last"),
        F.bool_and(F.coalesce(even_user | odd_reply, F.lit(False))).alias("alternates"),
        F.min(F.when(F.col("mapped").isNull(), F.struct("turn", "role"))).alias("unknown"),
    )
    status = (
        F.when(F.col("unknown").isNotNull(), F.concat(F.lit("dropped_role_"), F.col("unknown.role")))
        .when(F.col("alternates") & (F.col("n") % 2 == 0) & (F.col("last") + 1 == F.col("n")), F.lit("ok"))
        .otherwise(F.lit("dropped_shape"))
    )
    return facts.select(CONV, status.alias("status"), "n")


def valid_conversations(turns: DataFrame, names: dict[str, str] = M.ROLE_NAMES) -> DataFrame:
    """Turns, roles mapped, of the conversations whose status is ok."""
    good = conversation_status(turns, names).filter("status = 'ok'").select(CONV)
    return map_roles(turns, names).join(good, CONV, "left_semi")


def exact_roles(turns: DataFrame, roles: list[str], empty: tuple[int, ...] = (0,)) -> DataFrame:
    """Ids of conversations whose role sequence is exactly ``roles``, with blank text at the positions in ``empty``."""
    expected = F.lit(False)
    for i, role in enumerate(roles):
        fits = (F.col("turn") == i) & (F.col("role") == role)
        if i in empty:
            fits = fits & ~F.col("text").rlike(r"\S")
        expected = expected | fits
    return (
        turns.groupBy(CONV)
        .agg(F.count("*").alias("n"), F.bool_and(expected).alias("fits"))
        .filter(F.col("fits") & (F.col("n") == len(roles)))
        .select(CONV)
    )


def starts_with_user(turns: DataFrame) -> DataFrame:
    """Ids of conversations whose first message is the user's."""
    return turns.filter((F.col("turn") == 0) & (F.col("role") == "user")).select(CONV).distinct()


def first_turn_text(turns: DataFrame, auxiliary: str = "Reasoning:") -> DataFrame:
    """System prompts before the first user turn, joined by blank lines, then the first user text.

    Line feeds round the system prompts and before the user text are taken off. The first system message is skipped when it
    is the auxiliary header. Conversations without a user turn are left out.
    """
    user = turns.filter("role = 'user'").groupBy(CONV).agg(F.min(F.struct("turn", "text")).alias("u"))
    first = user.select(CONV, F.col("u.turn").alias("user_turn"), F.regexp_replace("u.text", r"\A\n+", "").alias("user_text"))
    bare = F.regexp_replace("text", r"\A\n+|\n+\z", "")
    system = turns.filter("role = 'system'").select(CONV, "turn", bare.alias("sys"))
    lead = (
        system.join(first.select(CONV, "user_turn"), CONV)
        .filter(F.col("turn") < F.col("user_turn"))
        .groupBy(CONV)
        .agg(F.sort_array(F.collect_list(F.struct("turn", "sys"))).alias("s"))
    )
    header = F.startswith(F.col("s")[0]["sys"], F.lit(auxiliary))
    kept = F.when(header, F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0)))).otherwise(F.col("s"))
    texts = F.filter(F.transform(kept, lambda m: m["sys"]), lambda t: t != "")
    joined = first.join(lead.select(CONV, F.array_join(texts, "\n\n").alias("system_text")), CONV, "left")
    system_text = F.coalesce("system_text", F.lit(""))
    return joined.select(
        CONV,
        F.when(system_text != "", F.concat(system_text, F.lit("\n\n"), F.col("user_text")))
        .otherwise(F.col("user_text"))
        .alias("first_text"),
    )


def drop_assistant(turns: DataFrame) -> DataFrame:
    """System and user turns with text, in their original order."""
    return turns.filter(F.col("role").isin("system", "user") & (F.col("text") != ""))


def split_reasoning(replies: DataFrame, content: str = "text", reasoning_on: Column | None = None) -> DataFrame:
    """``reasoning``, ``answer`` and whether a reasoning block was dropped because the row's flag is off."""
    on = F.lit(True) if reasoning_on is None else reasoning_on
    reasoning, answer = think_parts(F.col(content))
    return (
        replies.withColumn("answer", answer)
        .withColumn("__r", reasoning)
        .withColumn("reasoning", F.when(on, F.col("__r")).otherwise(F.lit("")))
        .withColumn("dropped_block", (~on) & (F.col("__r") != ""))
        .drop("__r")
    )


def strip_history_reasoning(turns: DataFrame) -> DataFrame:
    """Reasoning blocks removed from every assistant turn but the conversation's last assistant turn."""
    last = turns.filter("role = 'assistant'").groupBy(CONV).agg(F.max("turn").alias("last_reply"))
    earlier = (F.col("role") == "assistant") & (F.col("turn") < F.col("last_reply"))
    return (
        turns.join(last, CONV, "left")
        .withColumn("text", F.when(earlier, strip_think(F.col("text"))).otherwise(F.col("text")))
        .drop("last_reply")
    )


def rewrite_system(turns: DataFrame, pattern: str) -> DataFrame:
    """The one line matching ``pattern`` is removed from every system text and think tags are unwrapped.

    A system text without exactly one such line fails the job.
    """
    hits = F.regexp_count("text", F.lit(pattern))
    fixed = F.regexp_replace(F.regexp_replace("text", pattern, ""), r"(?s)<think>(.*?)</think>", "$1")
    checked = F.when(hits == 1, fixed).otherwise(
        F.raise_error(F.concat(F.lit("instruction line not found exactly once in conversation "), F.col(CONV)))
    )
    return turns.withColumn("text", F.when(F.col("role") == "system", checked).otherwise(F.col("text")))


def swap_header(rows: DataFrame, old: str, new: str, text: str = "text") -> DataFrame:
    """``old`` at the start of every text replaced by ``new``; a row without it fails the job."""
    rest = F.substring(F.col(text), len(old) + 1, 2**30)
    checked = F.when(F.startswith(F.col(text), F.lit(old)), F.concat(F.lit(new), rest)).otherwise(
        F.raise_error(F.lit(f"row does not start with {old!r}"))
    )
    return rows.withColumn(text, checked)


def last_solution(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("solution", solution_block(F.col(text)))


def compact_struct(rows: DataFrame, column: str) -> DataFrame:
    """Nested record as JSON text without its null fields."""
    return rows.withColumn(column, F.to_json(F.col(column), {"ignoreNullFields": "true"}))


# ---- rendering -------------------------------------------------------------------------------------------------


def turn_markup(role: Column, text: Column) -> Column:
    return F.concat(
        F.lit(M.START_HEADER), role, F.lit(M.END_HEADER), F.lit("\n"), text, F.lit(M.END_TURN), F.lit("\n")
    )


def turn_starts(turns: DataFrame, turns_per_slice: int = 1000) -> DataFrame:
    """Add ``n_piece`` and ``start``: tokens of a turn with its markers, and of the turns before it.

    Very long conversations are summed in slices of turns, not walked by one task.
    """
    sized = turns.withColumn("n_piece", marked_count(F.col("text")) + 4)
    return total_before(sized, [CONV], ["turn"], F.floor(F.col("turn") / turns_per_slice), "n_piece", "start")


def render(
    turns: DataFrame, mode: Column | None = None, keep: list[str] | None = None, clip_at: int | None = None
) -> DataFrame:
    """One text per conversation: opening marker, optional reasoning header, headed turns in order, closing marker.

    With ``clip_at``, turns that start beyond that many tokens are left out before a conversation is put together. The
    first ``clip_at`` tokens are the same, so a later ``clip`` to that length gives the same rows.
    """
    keep = keep or []
    if clip_at is not None:
        turns = turn_starts(turns).filter(F.col("start") < clip_at)
    pieces = turns.withColumn("piece", turn_markup(F.col("role"), F.col("text")))
    grouped = pieces.groupBy(CONV, *keep).agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("p"))
    header = F.lit("")
    if mode is not None:
        label = F.concat(F.lit("Reasoning: /"), mode, F.lit("\n"))
        header = F.when(mode.isNotNull(), turn_markup(F.lit("system"), label)).otherwise(F.lit(""))
    body = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    text = F.concat(F.lit(M.BEGIN_TEXT), header, body, F.lit(" " + M.END_TEXT))
    return grouped.select(CONV, *keep, text.alias("text"))


def parse_rendered(rows: DataFrame, key: str = CONV, text: str = "text") -> DataFrame:
    """Rendered text back to messages.

    Columns: key, turn, role, content, reasoning, calls (name and raw argument text), tool_name, tools, thinking.
    The auxiliary system header gives ``tools`` and ``thinking`` to every message and is no message itself.
    """
    body = F.col(text)
    body = F.when(F.startswith(body, F.lit(M.BEGIN_TEXT)), F.substring(body, len(M.BEGIN_TEXT) + 1, 2**30)).otherwise(
        F.raise_error(F.lit("row does not start with the opening marker"))
    )
    body = F.regexp_replace(body, M.DOCUMENT_END, "")
    parts = F.split(body, M.HEADER_START)
    head = rows.withColumn("__aux", F.element_at(parts, 2)).withColumn("__parts", parts)
    is_aux = F.startswith("__aux", F.lit("system" + M.END_HEADER))
    mode = F.regexp_extract("__aux", M.REASONING_MODE, 1)
    tools = F.regexp_extract("__aux", M.TOOL_LIST, 1)
    aux = is_aux & ((mode != "") | (tools != ""))
    first = F.when(aux, F.lit(3)).otherwise(F.lit(2))
    split_rows = head.select(
        key,
        F.when(aux & (tools != ""), tools).alias("tools"),
        F.when(aux & (mode != ""), mode == "/think").alias("thinking"),
        F.posexplode(F.slice("__parts", first, F.size("__parts"))).alias("turn", "__p"),
    )
    role = F.regexp_extract("__p", M.HEADER_ROLE, 1)
    raw = F.regexp_replace(F.regexp_replace("__p", M.HEADER_ROLE + r"\n?", ""), M.TURN_END, "")
    parsed = split_rows.withColumn("role", role).withColumn("__c", raw)
    is_reply = F.col("role") == "assistant"
    opened = is_reply & F.startswith("__c", F.lit(M.START_THINK)) & (F.instr("__c", M.END_THINK) > 0)
    inner = F.substring(F.col("__c"), len(M.START_THINK) + 1, 2**30)
    reasoning = F.when(opened, F.substring_index(inner, M.END_THINK, 1))
    after = F.when(opened, F.substr(inner, F.length(F.substring_index(inner, M.END_THINK, 1)) + len(M.END_THINK) + 1))
    said = F.coalesce(after, F.col("__c"))
    blocks = F.regexp_extract_all("__said", F.lit(M.TOOL_CALL_BLOCK), F.lit(1))
    calls = F.transform(
        blocks,
        lambda b: F.struct(
            F.get_json_object(b, "$.name").alias("name"),
            F.regexp_extract(b, r'(?s)"arguments": (.*)\}[^}]*$', 1).alias("arguments"),
        ),
    )
    is_tool = F.col("role") == "tool"
    reply = M.TOOL_RESPONSE
    result = F.when(F.col("__c").rlike(reply), F.regexp_extract("__c", reply, 2)).otherwise(F.col("__c"))
    content = (
        F.when(is_reply, F.substring_index("__said", M.TOOL_CALL, 1)).when(is_tool, result).otherwise(F.col("__c"))
    )
    name = F.when(is_tool, F.nullif(F.regexp_extract("__c", reply, 1), F.lit("")))
    return parsed.withColumn("__said", said).select(
        key,
        F.col("turn").cast("bigint").alias("turn"),
        "role",
        content.alias("content"),
        reasoning.alias("reasoning"),
        F.when(is_reply, calls).alias("calls"),
        name.alias("tool_name"),
        "tools",
        "thinking",
    )


def render_parsed(messages: DataFrame, key: str = CONV) -> DataFrame:
    """Inverse of ``parse_rendered``: reasoning, text, tool calls and tool results as they were written.

    Rows whose header lists tools are rendered without that list.
    """
    call = lambda c: F.concat(
        F.lit(M.TOOL_CALL + '\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n" + M.END_TOOL_CALL)
    )
    calls = F.coalesce(F.array_join(F.transform("calls", call), "\n"), F.lit(""))
    thought = F.concat(F.lit(M.START_THINK), F.col("reasoning"), F.lit(M.END_THINK))
    named = F.coalesce(F.concat(F.lit(' name="'), F.col("tool_name"), F.lit('"')), F.lit(""))
    result = F.concat(F.lit("<tool_response"), named, F.lit(">"), F.col("content"), F.lit("</tool_response>"))
    said = F.concat(F.coalesce(thought, F.lit("")), F.col("content"), calls)
    shown = F.when(F.col("role") == "tool", result).otherwise(said)
    label = F.when(F.col("thinking"), F.lit("think")).when(~F.col("thinking"), F.lit("nothink"))
    turns = messages.select(F.col(key).alias(CONV), "turn", "role", shown.alias("text"), label.alias("__mode"))
    return render(turns, mode=F.col("__mode"), keep=["__mode"]).drop("__mode").withColumnRenamed(CONV, key)


def roundtrip_audit(rows: DataFrame, key: str = CONV, text: str = "text") -> DataFrame:
    """Per row: whether render(parse(text)) is the text again, the first differing position, and the kind of failure.

    A row that was clipped has no closing marker; it is exact when the text begins with it. ``kind`` is null for exact rows,
    else ``tools`` (the header lists tools), ``shorter`` (the text ends early) or ``differs``.
    """
    again = render_parsed(parse_rendered(rows, key, text), key).withColumnRenamed("text", "again")
    both = rows.select(key, F.col(text).alias("original")).join(again, key, "left")
    closed = F.endswith("original", F.lit(M.END_TEXT))
    exact = F.coalesce((F.col("again") == F.col("original")) | (~closed & F.startswith("again", F.col("original"))), F.lit(False))
    shorter = F.least(F.length("again"), F.length("original"))
    first = F.when(~exact, first_difference(F.coalesce("again", F.lit("")), F.col("original"), F.coalesce(shorter, F.lit(0))))
    kind = (
        F.when(exact, F.lit(None))
        .when(F.col("original").rlike(M.TOOL_LIST), F.lit("tools"))
        .when(F.col("first_diff") >= F.length("again"), F.lit("shorter"))
        .otherwise(F.lit("differs"))
    )
    return both.select(key, "again", "original", exact.alias("exact"), first.cast("int").alias("first_diff")).select(
        key, "exact", "first_diff", kind.alias("kind")
    )


def roundtrip_share(audit: DataFrame) -> DataFrame:
    """One row: rows, exact rows, their share."""
    exact = F.count_if(F.col("exact"))
    return audit.agg(F.count("*").alias("n_rows"), exact.alias("n_exact"), (exact / F.count("*")).alias("share"))


def first_difference(a: Column, b: Column, shorter: Column) -> Column:
    """0-based position of the first differing character, or the shorter length: bisection on equal beginnings."""

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"] + 1) / 2).cast("int")
        same = F.substr(a, F.lit(1), middle) == F.substr(b, F.lit(1), middle)
        return F.struct(
            F.when(same, middle).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(middle - 1).alias("high")
        )

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(F.bin(shorter.cast("bigint")))))
    start = F.struct(F.lit(0).alias("low"), shorter.cast("int").alias("high"))
    return F.aggregate(steps, start, lambda s, i: F.when(s["low"] < s["high"], halve(s, i)).otherwise(s))["low"]


def mask_audit(rows: DataFrame, turns: DataFrame, least: int = 100, share: float = 0.99) -> DataFrame:
    """Supervised text decoded from token rows against the assistant texts they came from.

    ``turns`` may say in a boolean column ``changed`` which texts were changed on the way; their rows are left out. One row: compared, same, passed (at least ``least`` compared and at least ``share`` of them equal).
    """
    if "changed" in turns.columns:
        turns = turns.join(turns.filter("changed").select(CONV).distinct(), CONV, "left_anti")
    said = (
        turns.filter("role = 'assistant'")
        .groupBy(CONV)
        .agg(F.sort_array(F.collect_list(F.struct("turn", marked_tokens(F.col("text")).alias("w")))).alias("a"))
        .select(
            CONV,
            F.flatten(
                F.transform("a", lambda x: F.concat(x["w"], F.array(F.lit(M.END_TURN))))
            ).alias("want"),
        )
    )
    kept = F.filter("tokens", lambda t, i: F.get("mask", i) == 1)
    both = rows.select(F.col("id").alias(CONV), kept.alias("got")).join(said, CONV)
    counts = both.agg(
        F.count("*").alias("compared"), F.count_if(F.col("got") == F.col("want")).alias("same")
    )
    passed = (F.col("compared") >= least) & (F.col("same") >= share * F.col("compared"))
    return counts.withColumn("passed", passed)


def expand_per_turn(turns: DataFrame, longest: int | None = None) -> DataFrame:
    """One example per assistant turn: the text before it as prompt and its own text as the only supervised part.

    Examples of more than ``longest`` tokens are dropped, before any prompt is put together.
    """
    if longest is not None:
        turns = turn_starts(turns).filter(F.col("start") + F.col("n_piece") <= longest)
    before = W.partitionBy(CONV).orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    marked = turns.withColumn("piece", turn_markup(F.col("role"), F.col("text"))).withColumn(
        "prompt", F.array_join(F.collect_list("piece").over(before), "")
    )
    return marked.filter((F.col("role") == "assistant") & (F.col("turn") > 0)).select(
        CONV, "turn", "prompt", F.col("text").alias("reply")
    )


# ---- splits and picks ------------------------------------------------------------------------------------------


def hash_split(rows: DataFrame, key: str, share: float, out: str = "is_val") -> DataFrame:
    """Validation flag from the sha256 of the key, so all rows of one key fall on one side."""
    return rows.withColumn(out, key_fraction(F.sha2(F.col(key).cast("string"), 256)) < share)


def pick_turns(turns: DataFrame, seed: int, longest: int | None = None) -> DataFrame:
    """Per conversation the first assistant turn and one random later assistant turn.

    With ``longest``, only turns whose prompt (all before them) has at most that many tokens are drawn from, so a
    conversation is not lost because its draw was too long.
    """
    if longest is not None:
        turns = turn_starts(turns).filter(F.col("start") <= longest)
    replies = turns.filter((F.col("role") == "assistant") & (F.col("turn") > 0)).select(CONV, "turn")
    first = replies.groupBy(CONV).agg(F.min("turn").alias("first_turn"))
    later = (
        replies.join(first, CONV)
        .filter(F.col("turn") > F.col("first_turn"))
        .withColumn("h", order_key(seed, CONV, "turn"))
        .groupBy(CONV)
        .agg(F.min(F.struct("h", "turn")).alias("m"))
        .select(CONV, F.col("m.turn").alias("turn"), F.lit("later").alias("turn_kind"))
    )
    return first.select(CONV, F.col("first_turn").alias("turn"), F.lit("first").alias("turn_kind")).unionByName(later)
