"""Hand-made rows for the edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import markers as M
from tallyloom.functions.text import solution_block, squeeze_space, think_parts
from tallyloom.operators import aggregates as A
from tallyloom.operators import compare as C
from tallyloom.operators import contamination as N
from tallyloom.operators import conversations as V
from tallyloom.operators import evaluation as E
from tallyloom.operators import joins as J
from tallyloom.operators import regen as R
from tallyloom.operators import selection as S
from tallyloom.operators import sets as X
from tallyloom.operators import similarity as K
from tallyloom.operators import token_rows as T
from tallyloom.operators.texts import normalize_text
from tallyloom.sources.readers import parse_metrics, record_pairs, with_acceptance

ROW = "id bigint, tokens array<string>, mask array<tinyint>, n int"


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, [str(t) for t in tok], list(m), len(tok)) for i, (tok, m) in enumerate(rows)], ROW)


def turns_of(spark, *convs):
    data = [(c, t, role, text) for c, conv in enumerate(convs) for t, (role, text) in enumerate(conv)]
    return spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")


# ---- token rows ------------------------------------------------------------------------------------------------


def test_empty_mask_is_dropped(spark):
    rows = rows_of(spark, ([5, 6, 7], [0, 0, 0]), ([5, 6], [0, 1]))
    assert [r.id for r in T.drop_unsupervised(rows).collect()] == [1]


def test_mask_past_the_clip(spark):
    clipped = T.clip(rows_of(spark, (range(6), [0, 0, 0, 0, 1, 1])), 4)
    row = clipped.first()
    assert (row.n, row.clipped, row.tokens) == (4, 2, ["0", "1", "2", "3"])
    assert T.drop_unsupervised(clipped).count() == 0


def test_span_at_zero(spark):
    rows = rows_of(spark, ([7, 8, 9], [1, 0, 1]))
    assert T.prompt_before_last_span(rows, 100).first().prompt == ["7", "8"]
    assert T.prompt_before_first_span(rows, 0, 100).first().prompt == []
    assert T.prompt_before_last_span(rows_of(spark, ([7, 8], [1, 1])), 100).count() == 0


def test_two_spans(spark):
    spans = T.mask_spans(rows_of(spark, (range(6), [0, 0, 1, 1, 0, 1]))).orderBy("span").collect()
    assert [(r.s, r.e) for r in spans] == [(2, 4), (5, 6)]


@pytest.mark.parametrize(
    "tokens, mask",
    [
        ([M.START_HEADER, "assistant", M.END_HEADER, "a", "b"], [0, 0, 0, 1, 1]),
        ([M.START_HEADER, "assistant", M.END_HEADER, "a", M.END_TURN, M.END_TEXT], [0, 0, 0, 1, 1, 0]),
        ([M.START_HEADER, "user", M.END_HEADER, "a", M.END_TURN], [0, 0, 0, 0, 0]),
        # An opened turn swallows a header inside it until the end of turn.
        ([M.START_HEADER, "assistant", M.END_HEADER, "a", M.START_HEADER, "user", M.END_HEADER, "b", M.END_TURN, "c"],
         [0, 0, 0, 1, 1, 1, 1, 1, 1, 0]),
        ([M.START_HEADER, "assistant", M.END_HEADER], [0, 0, 0]),
        (["x"], [0]),
        # Two assistant turns in a row.
        ([M.START_HEADER, "assistant", M.END_HEADER, M.END_TURN] * 2, [0, 0, 0, 1] * 2),
    ],
)
def test_assistant_mask(spark, tokens, mask):
    df = spark.createDataFrame([(tokens,)], "tokens array<string>")
    assert df.select(T.assistant_mask(F.col("tokens")).alias("m")).first().m == mask


def test_assistant_mask_skips_newline_token(spark):
    tokens = [M.START_HEADER, "assistant", M.END_HEADER, "NL", "a", M.END_TURN]
    df = spark.createDataFrame([(tokens,)], "tokens array<string>")
    assert df.select(T.assistant_mask(F.col("tokens"), newline_tokens=1).alias("m")).first().m == [0, 0, 0, 0, 1, 1]


def test_clip_left_of_empty_row(spark):
    out = T.clip_left(rows_of(spark, ([], []), ([1, 2, 3], [0, 0, 0])), 3, ["p"]).orderBy("id").collect()
    assert [r.tokens for r in out] == [["p"], ["p", "2", "3"]]
    assert [r.cut for r in out] == [False, True]


def test_tokenizer_plug(spark):
    @F.pandas_udf("array<string>")
    def letters(texts):
        return texts.map(list)

    df = spark.createDataFrame([("abc",)], "text string")
    assert T.tokenize(df, tokenizer=letters).first().tokens == ["a", "b", "c"]


# ---- conversations ---------------------------------------------------------------------------------------------


def test_bad_shapes(spark):
    turns = turns_of(
        spark,
        [("gpt", "a"), ("human", "b")],
        [("human", "a"), ("human", "b")],
        [("human", "a"), ("gpt", "b"), ("human", "c")],
        [("human", "a"), ("tool", "b"), ("gpt", "c"), ("robot", "d")],
        [("human", "a"), ("gpt", "b")],
    )
    status = {r.conv_id: r.status for r in V.conversation_status(turns).collect()}
    assert status == {0: "dropped_shape", 1: "dropped_shape", 2: "dropped_shape", 3: "dropped_role_tool", 4: "ok"}


def test_reasoning_blocks(spark):
    texts = ["<think>abc", "<think> a </think> b ", " c ", "<think></think>d"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    reasoning, answer = think_parts(F.col("text"))
    out = [tuple(r) for r in df.select(reasoning, answer).collect()]
    assert out == [("abc", ""), ("a", "b"), ("", "c"), ("", "d")]


@pytest.mark.parametrize(
    "text, block",
    [
        ("<solution>a</solution>", "a"),
        ("before <solution>\n two words \n</solution> after", "two words"),
        # The last closer counts, with the opener nearest before it.
        ("<solution>a</solution><solution>b</solution>", "b"),
        ("<solution>a</solution><solution>b", "a"),
        ("<solution>a<solution> b </solution> t", "b"),
        # Nothing between the tags, tags in the wrong order, one missing, no tag at all.
        ("<solution> </solution>", None),
        ("</solution><solution>", None),
        ("<solution>open", None),
        ("x", None),
        # A block that holds other tags is no answer.
        ("<solution><sql>q</solution>", None),
        ("<solution>a<SQL>b</solution>", None),
    ],
)
def test_solution_block(spark, text, block):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(solution_block(F.col("text"))).first()[0] == block


def test_long_conversations_are_cut_before_they_are_joined(spark):
    turns = turns_of(spark, [("user" if t % 2 == 0 else "assistant", f"a{t} b c") for t in range(50)], [("user", "x")])
    for clip_at in (1, 7, 40, 400):
        whole = T.clip(T.masked_rows(V.render(turns), "conv_id"), clip_at).select("id", "tokens", "mask", "n")
        early = T.clip(T.masked_rows(V.render(turns, clip_at=clip_at), "conv_id"), clip_at).select("id", "tokens", "mask", "n")
        assert sorted(map(str, whole.collect())) == sorted(map(str, early.collect()))
    every = {(r.conv_id, r.turn): r.prompt for r in V.expand_per_turn(turns).collect()}
    short = {(r.conv_id, r.turn): r.prompt for r in V.expand_per_turn(turns, longest=50).collect()}
    assert short == {k: p for k, p in every.items() if (k[1] + 1) * 7 <= 50}


def test_swap_header_fails_on_violation(spark):
    df = spark.createDataFrame([("old x",), ("other",)], "text string")
    with pytest.raises(Exception, match="does not start with"):
        V.swap_header(df, "old", "new").collect()


def test_rewrite_system_needs_exactly_one(spark):
    turns = turns_of(spark, [("system", "rule\nrule\n")])
    with pytest.raises(Exception, match="not found exactly once"):
        V.rewrite_system(turns, r"rule\n").collect()


def test_whitespace_runs(spark):
    df = spark.createDataFrame([("a" + " " * 500 + "b",), ("a" + " " * 128 + "b",)], "t string")
    assert [len(r[0]) for r in df.select(squeeze_space(F.col("t"))).collect()] == [130, 130]


def test_first_difference(spark):
    rows = spark.createDataFrame([(0, M.BEGIN_TEXT + M.START_HEADER + "user" + M.END_HEADER + "x" + M.END_TURN + "\n " + M.END_TEXT)],
                                 "conv_id bigint, text string")
    out = V.roundtrip_audit(rows).first()
    # The newline behind the header is missing in the original.
    assert (out.exact, out.first_diff) == (False, len(M.BEGIN_TEXT + M.START_HEADER + "user" + M.END_HEADER))


def test_first_difference_of_long_texts(spark):
    text = "a" * 80_000
    rows = spark.createDataFrame([(0, text, text[:50_000] + "b" + text[50_001:]), (1, text, text[:700]), (2, "", "x"), (3, "xy", "y")], "i int, a string, b string")
    d = V.first_difference(F.col("a"), F.col("b"), F.least(F.length("a"), F.length("b")))
    assert [r[0] for r in rows.orderBy("i").select(d).collect()] == [50_000, 700, 0, 0]


def rendered(body, closed=True):
    turn = f"{M.START_HEADER}user{M.END_HEADER}\nhi{M.END_TURN}\n{M.START_HEADER}assistant{M.END_HEADER}\n{body}{M.END_TURN}\n"
    return M.BEGIN_TEXT + turn + (" " + M.END_TEXT if closed else "")


def test_tools_and_clipped_rows_go_round(spark):
    call = M.TOOL_CALL + '\n{"name": "run", "arguments": {"x": 1}}\n' + M.END_TOOL_CALL
    tool = f'{M.END_TURN}\n{M.START_HEADER}tool{M.END_HEADER}\n<tool_response name="run">3</tool_response>'
    texts = [rendered("ok " + call), rendered(call + "\n" + call), rendered("ok " + call + tool), rendered("cut sho", closed=False)[:-20], rendered("x").replace("hi", "\nhi", 1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "conv_id bigint, text string")
    audit = V.roundtrip_audit(rows)
    got = {r.conv_id: (r.exact, r.first_diff, r.kind) for r in audit.collect()}
    assert [got[i][0] for i in range(4)] == [True] * 4
    share = V.roundtrip_share(audit).first()
    assert share.n_rows == 5 and share.n_exact >= 4


def test_white_space_is_blank(spark):
    turns = turns_of(spark, [("system", "\n\t"), ("user", "a"), ("assistant", "b")], [("system", "x"), ("user", "a"), ("assistant", "b")])
    assert [r.conv_id for r in V.exact_roles(turns, ["system", "user", "assistant"]).collect()] == [0]
    turns = turns_of(spark, [("system", "\nReasoning: /think"), ("system", "\nBe brief.\n"), ("system", "\n"), ("user", "\n\nhi\n")])
    assert V.first_turn_text(turns).first().first_text == "Be brief.\n\nhi\n"
    docs = spark.createDataFrame([("\n\t",), ("a",), ("",)], "text string")
    assert [r.text for r in normalize_text(docs).collect()] == ["a"]


def test_later_turn_is_drawn_within_the_limit(spark):
    long = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e " * 500), ("assistant", "f")]
    turns = turns_of(spark, *[long] * 20)
    picked = V.pick_turns(turns, 1, longest=100).collect()
    assert {(r.turn, r.turn_kind) for r in picked} == {(1, "first"), (3, "later")} and len(picked) == 40


def test_changed_texts_are_not_compared(spark):
    turns = turns_of(spark, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")])
    rows = T.masked_rows(V.render(turns), "conv_id")
    said = turns.withColumn("text", F.when(F.col("conv_id") == 1, F.lit("other")).otherwise(F.col("text")))
    assert tuple(V.mask_audit(rows, said, 1).first())[:2] == (2, 1)
    assert tuple(V.mask_audit(rows, said.withColumn("changed", F.col("conv_id") == 1), 1).first())[:2] == (1, 1)


def test_rows_without_tokens_or_words_stay(spark):
    vocab = spark.createDataFrame([("a", 5)], "token string, token_id int")
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id bigint, tokens array<string>")
    assert {r.id: r.input_ids for r in T.encode(rows, vocab, 0, 1, 9).collect()} == {1: [0, 5, 9, 1], 2: [0, 1], 3: [0, 1]}
    texts = spark.createDataFrame([(1, "a a b"), (2, " "), (3, None)], "id bigint, text string")
    vecs = {r.id: r.vec for r in K.embed(texts, "id", dim=8).collect()}
    assert sorted(vecs) == [1, 2, 3] and vecs[2] == vecs[3] == [0.0] * 8
    assert sum(x * x for x in vecs[1]) == pytest.approx(1)


def test_moving_average_of_any_steps(spark):
    log = spark.createDataFrame([("a", 16, 1.0), ("a", 32, 2.0), ("a", 48, 3.0), ("b", 5, 7.0)], "arm string, done bigint, accept double")
    for per_slice in (1, 20, 1000):
        got = {(r.arm, r.done): r.smooth for r in E.moving_average(log, 1, per_slice).collect()}
        assert got == {("a", 16): 1.0, ("a", 32): 1.5, ("a", 48): 2.5, ("b", 5): 7.0}


def test_rows_without_supervision_count_apart(spark):
    stats = spark.createDataFrame([("m", True, 100, 0, 0), ("m", True, 100, 40, 1)], "mode string, terminal boolean, n_tokens int, n_supervised int, n_assistant int")
    total = A.mode_crosstab(stats, 100).filter("mode IS NULL AND terminal IS NULL").first()
    assert (total.n_rows, total.tokens, total.prompt_tokens, total.window_rows, total.turns, total.empty_rows) == (2, 200, 60, 1, 1, 1)
    rows = rows_of(spark, ([M.START_THINK, "a"], [0, 0])).withColumn("mode", F.lit("m"))
    assert C.think_stats(rows, ["mode"]).count() == 0


def test_every_vocabulary_and_model_is_shown(spark):
    freq = spark.createDataFrame([("a", 5), ("b", 3), ("7", 2)], "token string, cnt bigint")
    vocabs = spark.createDataFrame([(f"v{i:03}", "a") for i in range(150)] + [("v000", "b"), ("w", "zzz")], "vocab string, token string")
    cover = {r.vocab: (r.tokens, r.covered) for r in C.vocab_coverage(freq, vocabs).collect()}
    assert len(cover) == 151 and cover["v000"] == (10, 8) and cover["v149"] == (10, 5) and cover["w"] == (10, 0)
    missed = {(r.vocab, r["class"]): r.cnt for r in C.uncovered_classes(freq, vocabs).collect()}
    assert missed["v149", "english"] == 3 and missed["w", "english"] == 8 and ("v000", "english") not in missed and missed["v000", "digits"] == 2
    top = C.top_uncovered(freq.withColumn("g", F.lit(1)), vocabs, 1, ["g"]).collect()
    assert {r.vocab: r.token for r in top} == {"v000": "7", "w": "a"} | {f"v{i:03}": "b" for i in range(1, 150)}
    models = spark.createDataFrame([(f"m{i}", "a", i + 1) for i in range(150)], "model string, token string, cnt bigint")
    bits = {r.model: r.bits for r in C.cross_entropy(freq.withColumn("eval_set", F.lit("e")), models, 100).collect()}
    assert len(bits) == 150
    assert bits["m9"] == pytest.approx(-0.5 * math.log2(10.5 / 60) - 0.5 * math.log2(0.5 / 60))


def test_too_few_rows_are_refused(spark):
    rows = spark.range(10).select("id", F.lit(1).alias("n"))
    with pytest.raises(ValueError, match="asked for"):
        S.sample_n(rows, 11, 1, "id")
    with pytest.raises(ValueError, match="regenerated part"):
        X.mix_datasets(rows.filter("id < 3"), rows, 8, 1, 1, 1)
    assert {r.b: r.missing for r in S.short_buckets(spark.createDataFrame([(1,), (1,), (2,)], "b int"), "b", 2).collect()} == {2: 1}


# ---- selection -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("target, taken", [(6, 2), (7, 3), (9, 3), (0, 0), (100, 3)])
def test_budget_tie_and_overshoot(spark, target, taken):
    stats = spark.createDataFrame([("s", i, 3) for i in range(3)], "source string, id bigint, n bigint")
    targets = spark.createDataFrame([("s", target)], "source string, target bigint")
    assert S.budget_select(stats, targets, 1).count() == taken


def test_store_below_allocation_is_refused(spark):
    stats = spark.createDataFrame([("s", 0, 9)], "source string, id bigint, n bigint")
    mix = spark.createDataFrame([("s", 10)], "source string, allocated bigint")
    status = S.allocation_status(mix, stats)
    assert status.first().status == "below"
    with pytest.raises(ValueError, match="refusing"):
        S.refuse_partial(status)


def near_of(spark, rows):
    return spark.createDataFrame(rows, "query bigint, rank int, id bigint, score double")


def test_shared_neighbour(spark):
    near = near_of(spark, [(0, 1, 9, 0.9), (1, 1, 9, 0.8), (0, 2, 5, 0.5), (1, 2, 6, 0.4)])
    lengths = spark.createDataFrame([(9, 2), (5, 2), (6, 2)], "id bigint, n bigint")
    plain = sorted((r.round, r.query, r.id) for r in S.round_robin_select(near, lengths, 100, 1).collect())
    assert plain == [(1, 0, 9), (1, 1, 9), (2, 0, 5), (2, 1, 6)]
    dedup = sorted((r.round, r.query, r.id) for r in S.round_robin_select(near, lengths, 100, 1, dedup=True).collect())
    assert dedup == plain


@pytest.mark.parametrize("dedup", [False, True])
@pytest.mark.parametrize("budget", [10, 150, 400, 10_000])
def test_rounds_keep_the_rules(spark, dedup, budget):
    """Whole rounds fit, what the boundary round skips did not fit in its turn, and no row comes after it was taken."""
    import hashlib

    rnd = random.Random(3)
    near = {(q, r): i for q in range(8) for r, i in enumerate(rnd.sample(range(20), 6), 1)}
    n = {i: rnd.randint(1, 30) for i in range(20)}
    df = near_of(spark, [(q, r, i, 1.0 / r) for (q, r), i in near.items()])
    lengths = spark.createDataFrame(list(n.items()), "id bigint, n bigint")
    got = S.round_robin_select(df, lengths, budget, 5, dedup).collect()
    by_round = {}
    for r in got:
        assert near[r.query, r.rank] == r.id and r.n == n[r.id]
        assert r.query not in by_round.setdefault(r.round, {})
        by_round[r.round][r.query] = r
    assert sum(r.n for r in got) <= budget
    assert sorted(by_round) == list(range(1, len(by_round) + 1))
    first = {q: near[q, 1] for q in range(8)}
    if sum(n[i] for i in first.values()) <= budget:
        assert {q: r.id for q, r in by_round[1].items()} == first
    earlier = set()
    for turn in sorted(by_round):
        rows = by_round[turn]
        if dedup:
            # The nearest row of the query that no earlier round took.
            for q, r in rows.items():
                assert r.id not in earlier and all(near[q, k] in earlier for k in range(1, r.rank))
        else:
            assert all(r.rank == turn for r in rows.values())
        if turn < max(by_round):
            open_queries = [q for q in range(8) if any(near[q, k] not in earlier for k in range(1, 7))] if dedup else range(8)
            assert sorted(rows) == sorted(open_queries)
        earlier |= {r.id for r in rows.values()}
    last = max(by_round, default=0)
    if last and len(by_round[last]) < 8 and not dedup:
        room = budget - sum(r.n for r in got if r.round < last)
        for q in sorted(range(8), key=lambda q: hashlib.md5(f"5:{last}:{q}".encode()).hexdigest()):
            fits = n[near[q, last]] <= room
            assert fits == (q in by_round[last])
            room -= n[near[q, last]] if fits else 0


def test_boundary_round_skips_and_goes_on(spark):
    """Room for 500: every row is taken that fits when its turn comes."""
    import hashlib

    rnd = random.Random(1)
    sizes = [rnd.randint(1, 40) for _ in range(300)]
    offered = spark.createDataFrame(
        [(q, 1, q, 1.0, n, 1) for q, n in enumerate(sizes)], "query bigint, rank int, id bigint, score double, n bigint, round int"
    )
    taken = {r.query for r in S._fit_in_order(offered, 500, 2).collect()}
    room = 500
    for q in sorted(range(300), key=lambda q: hashlib.md5(f"2:1:{q}".encode()).hexdigest()):
        assert (sizes[q] <= room) == (q in taken)
        room -= sizes[q] if q in taken else 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame(
        [(i, f"k{i}") for i in range(40)] + [(i + 1, f"k{i}") for i in range(39)] + [(100, "x"), (101, "x"), (200, "y")],
        "node bigint, key string",
    )
    got = {r.node: r.component for r in S.group_components(edges).collect()}
    assert all(got[i] == 0 for i in range(40)) and got[100] == got[101] == 100 and got[200] == 200


def test_heaviest_groups_go_to_the_lightest_shards(spark):
    groups = spark.createDataFrame([(1, 9), (2, 7), (3, 7), (4, 4), (5, 4), (6, 4), (7, 1)], "component bigint, weight bigint")
    got = {r.component: r.shard for r in S.balance_groups(groups, 3).collect()}
    # 9 | 7 | 7, then the fours: on 7 (shard 1), 7 (shard 2), 9 (shard 0), and the one on 11 (shard 1).
    assert got == {1: 0, 2: 1, 3: 2, 4: 1, 5: 2, 6: 0, 7: 1}


def test_every_group_in_one_shard(spark):
    groups = spark.createDataFrame([(f"g{i}", i * i % 97 + 1) for i in range(900)], "component string, weight bigint")
    placed = S.balance_groups(groups, 5).collect()
    assert sorted(r.component for r in placed) == sorted(f"g{i}" for i in range(900))
    loads = [sum(r.weight for r in placed if r.shard == s) for s in range(5)]
    assert max(loads) - min(loads) <= 1


def test_many_equal_groups_balance_exactly(spark):
    groups = spark.range(200_000).select(F.col("id").alias("component"), F.lit(3).alias("weight"))
    shards = S.balance_groups(groups, 8).groupBy("shard").count().collect()
    assert {r.shard: r["count"] for r in shards} == dict.fromkeys(range(8), 25_000)


def test_stratified_is_no_prefix(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("s"))
    picked = [r.id for r in S.stratified_sample(rows, "s", 20, 1, "id").collect()]
    assert len(picked) == 40 and max(picked) > 500


def test_split_ratio_round_trips():
    for total in range(1, 400, 7):
        for train in range(total):
            assert int(total * S.split_ratio(train, total)) == train


# ---- comparison ------------------------------------------------------------------------------------------------


def test_vocabulary_padding(spark):
    freq = spark.createDataFrame([(3, 10), (5, 10)], "token bigint, cnt bigint")
    got = [(r.draft_idx, r.token, r.d2t) for r in C.draft_vocab(freq, 4, 6).orderBy("draft_idx").collect()]
    assert got == [(0, 0, 0), (1, 1, 0), (2, 3, 1), (3, 5, 2)]


def test_token_classes(spark):
    want = {"<|x|>": "special", "漢字": "cjk", "é": "other_non_ascii", "12": "digits", " ": "whitespace", "\\frac": "latex_code",
            "word": "english", "a1": "mixed", "--": "punctuation", "$": "latex_code", "한": "cjk"}
    df = spark.createDataFrame([(t,) for t in want], "token string")
    assert {r.token: r["class"] for r in C.token_classes(df).collect()} == want


def test_log2_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 7, 8, 2**29 - 1, 2**40)], "n bigint")
    assert [r[0] for r in df.select(A.log2_bucket(F.col("n"))).collect()] == [0, 1, 1, 2, 3, 3, 19, 19]


def test_shared_gram_belongs_to_the_first(spark):
    words = [f"w{i}" for i in range(40)]
    problems = spark.createDataFrame([(1, words), (2, words[:35] + ["z"] * 5), (3, words[:10])], "item_id bigint, tokens array<string>")
    rows = rows_of(spark, (words, [0] * 40))
    grams = N.problem_grams(problems)
    totals = {r.item_id: r.total for r in N.problem_totals(grams).collect()}
    assert totals == {1: 28, 2: 28}  # the third is too short to test
    hits = {r.item_id: r.found for r in N.ngram_hits(rows, problems).collect()}
    assert hits == {1: 28}  # the shared n-grams count for the first only
    summary = {r.item_id: r.best for r in N.contamination(N.ngram_hits(rows, problems), N.problem_totals(grams)).collect()}
    assert summary == {1: 1.0, 2: 0.0}
    kept = J.drop_flagged(problems, N.flagged_items(spark.createDataFrame(list(summary.items()), "item_id bigint, best double")), ["item_id"])
    assert sorted(r.item_id for r in kept.collect()) == [2, 3]


def test_supervised_windows_do_not_count(spark):
    words = [f"w{i}" for i in range(40)]
    problems = spark.createDataFrame([(1, words)], "item_id bigint, tokens array<string>")
    mask = [0] * 40
    mask[20] = 1
    assert {r.found for r in N.ngram_hits(rows_of(spark, (words, mask)), problems).collect()} == {15}


# ---- evaluation ------------------------------------------------------------------------------------------------


def test_counter_reset(spark):
    scrapes = spark.createDataFrame([("e", "c", i, v) for i, v in enumerate([5.0, 9.0, 2.0])], "engine string, name string, scrape bigint, value double")
    for width in (1, 2, 100):
        got = [r.delta for r in E.counter_delta(scrapes, F.floor(F.col("scrape") / width)).orderBy("scrape").collect()]
        assert got == [None, 4.0, 2.0]


def test_duplicate_and_missing_steps(spark):
    log = spark.createDataFrame([("r", s, i) for i, s in enumerate([1, 2, 2, 4])], "run string, step bigint, line bigint")
    first = {r.step: (r.line, r.duplicates) for r in E.first_per_step(log, ["run", "step"], "line").collect()}
    assert first == {1: (0, 0), 2: (1, 1), 4: (3, 0)}
    assert [r.step for r in E.missing_steps(log, "run", "step", 2).collect()] == [3]


def test_pooled_not_averaged(spark):
    c = spark.createDataFrame([("a", 10, 50, 20), ("b", 90, 450, 90)], "subset string, drafts bigint, draft_tokens bigint, accepted_tokens bigint")
    got = {r.subset: r.acceptance_length for r in E.acceptance(c).collect()}
    assert got == {"a": 3.0, "b": 2.0, "all": 2.1}


def test_accepted_length(spark):
    b = spark.createDataFrame([(0, [True, True, False, True], [0.5, 0.5, 1.0]), (1, [True], [1.0]), (2, [False], [0.0])],
                              "block bigint, correct array<boolean>, rate array<double>")
    got = [(r.accepted, r.expected) for r in E.accepted_length(b).orderBy("block").collect()]
    assert got == [(3, 2.0), (2, 2.0), (1, 1.0)]


# ---- regeneration ----------------------------------------------------------------------------------------------


def replies_of(spark, *rows):
    return spark.createDataFrame(rows, "id bigint, k int, reply array<string>, finish string")


def test_splice(spark):
    rows = rows_of(spark, ("abcdefgh", [0, 0, 1, 1, 0, 1, 0, 0]))
    two = replies_of(spark, (0, 0, ["X"], "stop"), (0, 1, ["Y", "Z"], "stop"))
    out = R.splice_replies(rows, two, 100).first()
    assert ("".join(out.tokens), out.status, [(s.s, s.e) for s in out.spans]) == ("abXeYZgh", "complete", [(2, 3), (4, 6)])
    capped = R.splice_replies(rows, replies_of(spark, (0, 0, ["X"], "length")), 100).first()
    assert ("".join(capped.tokens), capped.status, capped.n_regenerated) == ("abX", "capped", 1)
    full = R.splice_replies(rows, replies_of(spark, (0, 0, ["X"] * 5, "stop")), 8).first()
    assert ("".join(full.tokens), full.status, full.n_regenerated) == ("abXXXXXe", "total_len", 1)
    assert R.splice_replies(rows, replies_of(spark, (0, 0, ["X"], "stop")), 100).count() == 0  # waits for the second reply
    bare = R.splice_replies(rows_of(spark, ("ab", [0, 0])), two.filter("false"), 100).first()
    assert ("".join(bare.tokens), bare.status, bare.spans) == ("ab", "no_assistant_turn", [])
    parts = R.merge_parts(R.splice_replies(rows, two, 100), 0).first()
    assert list(parts["mask"]) == [0, 0, 1, 0, 1, 1, 0, 0]


def test_frontier(spark):
    rows = rows_of(spark, ("abcdefgh", [0, 0, 1, 1, 0, 1, 0, 0]))
    none = replies_of(spark, (9, 0, ["q"], "stop"))
    first = R.next_prompts(rows, none, 0, 100, 10, 3).first()
    assert (first.prompt, first.prompt_tokens, first.max_tokens) == (["a", "b"], 2, 10)
    assert first.request_seed == (3 * 1_000_003) & 0x7FFFFFFF
    second = R.next_prompts(rows, replies_of(spark, (0, 0, ["X"], "stop")), 1, 100, 10, 3).first()
    assert "".join(second.prompt) == "abXe"
    assert R.next_prompts(rows, replies_of(spark, (0, 0, ["X"], "length")), 1, 100, 10, 3).count() == 0


def test_error_share_guard(spark):
    out = spark.createDataFrame([("e",), (None,)], "error string")
    R.error_share_guard(out, 0.5)
    with pytest.raises(ValueError):
        R.error_share_guard(out, 0.4)


# ---- guards ----------------------------------------------------------------------------------------------------


def test_uniqueness_and_overlap_guards(spark):
    a = spark.createDataFrame([(1, 0), (2, 0)], "row bigint, part bigint")
    with pytest.raises(ValueError, match="rows in both"):
        X.gather_parts(a, a)
    with pytest.raises(ValueError, match="duplicate"):
        X.assert_unique(a, ["part"])
    with pytest.raises(ValueError, match="both sides"):
        X.require_no_overlap(a, a, ["row"])


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(10)] + [(99, [0.0, 1.0])], "id bigint, vec array<double>").repartition(5)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query bigint, vec array<double>")
    assert [r.id for r in K.knn_topk(q, docs, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_query_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id bigint, vec array<double>").repartition(4)
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(12)], "query bigint, vec array<double>")
    whole = sorted(map(tuple, K.knn_topk(q, docs, 4).collect()))
    monkeypatch.setattr(K, "BLOCK_BYTES", 64)
    monkeypatch.setattr(K, "TILE_CELLS", 5)
    assert sorted(map(tuple, K.knn_topk(q, docs, 4).collect())) == whole
    assert K.knn_topk(q.limit(0), docs, 4).collect() == []


# ---- metric text and log lines ---------------------------------------------------------------------------------


def test_metric_lines(spark):
    lines = ['# TYPE a counter', 'a_total{x="{}",position="1"} 5 1700000000', 'a_total{x="q\\"}",position="1"} 5', "b 1e3", "c{} -Inf", "d 1 2 3", "e x"]
    df = spark.createDataFrame([("r", line) for line in lines], "run string, value string")
    got = {(r.name, r.position): r.total for r in parse_metrics(df, ["run"]).collect()}
    assert got == {("a", 1): 10.0, ("b", None): 1000.0, ("c", None): float("-inf")}


def test_record_pairs_hold_what_loggers_print(spark):
    df = spark.createDataFrame([("train/loss=nan, lr=-inf a=None b=1.5e-3,c=x d=2 e=1d =4 f= g 7",)], "t string")
    got = df.select(record_pairs("t")).first()[0]
    assert [p.key for p in got] == ["train/loss", "lr", "a", "b", "d"]


def test_acceptance_tables_of_any_layout(spark, tmp_path):
    """Columns in any order, a pooled row or not, no such column, a header only, an empty file, no file."""
    tables = {
        "a": "subset,requests,acceptance_length\nfirst,3,1.5\nall,5,2.5\n", "b": "acceptance_length,subset\r\n1.25,later\r\n",
        "c": "subset,requests\nall,5\n", "d": "subset,acceptance_length\n", "e": "", "f": None,
    }
    for name, text in tables.items():
        (tmp_path / name).mkdir()
        if text is not None:
            (tmp_path / name / "acceptance.csv").write_text(text, newline="")
    runs = spark.createDataFrame([(f"file:{tmp_path}/{name}",) for name in tables], "run string")
    path = f"file:{tmp_path}"
    got = {r.run[-1]: r.acceptance_length for r in with_acceptance(spark, runs, path).collect()}
    assert got == {"a": 2.5, "b": 1.25, "c": None, "d": None, "e": None, "f": None}


def test_mixed_rows_stay_whole(spark):
    """Tokens stay with their row, a column of one side only is null on the other, and the ratio gives the training rows."""
    original = spark.range(6).selectExpr("id", "array(id) AS tokens", "1L AS n", "id AS part_of")
    regenerated = spark.range(3, 20).selectExpr("id", "array(id, id) AS tokens", "2L AS n")
    mixed = X.mix_datasets(original, regenerated, 7, 2, 3, 1)
    rows = mixed.collect()
    assert len(rows) == 16 and all(r.tokens == [r.id] * r.n for r in rows)
    assert all((r.part == "original") == (r.part_of is not None) for r in rows)
    report = {r.part: r for r in X.mix_report(mixed).collect()}
    assert (report["original"].train_rows, report["regenerated"].train_rows, report[None].val_rows) == (4, 7, 5)
    assert int(16 * report[None].train_ratio) == report[None].train_rows == 11


def test_quota_halves_go_to_even(spark):
    rows = spark.createDataFrame([(s,) for s, n in (("a", 10), ("b", 6), ("c", 2)) for _ in range(n)], "source string")
    assert {r.source: r.quota for r in X.share_quota(rows, "source", 0.25).collect()} == {"a": 2, "b": 2, "c": 0}


def test_published_trajectories_compressed(spark, tmp_path):
    """A zstd file of two tasks, one without any attempt."""
    import json

    import zstandard

    from tallyloom.queries.sources_sinks import ATTEMPTS
    from tallyloom.sources import readers

    usage = {"response": {"usage": {"prompt_tokens": 7, "completion_tokens": 3}}}
    messages = [{"role": "user"}, {"role": "assistant", "extra": usage}, {"role": "assistant"}]
    tasks = [{"task_name": "t", "attempts": [{"trajectory": {"messages": messages}}, {"trajectory": None}]}, {"task_name": "u", "attempts": []}]
    text = "\n".join(json.dumps(t) for t in tasks)
    (tmp_path / "part.jsonl.zst").write_bytes(zstandard.compress(text.encode()))
    records = readers.read_jsonl(spark, f"file:{tmp_path}", ATTEMPTS)
    got = [tuple(r) for r in readers.explode_trajectories(readers.attempt_messages(records)).collect()]
    assert got == [("t", 1, 7, 3)]
