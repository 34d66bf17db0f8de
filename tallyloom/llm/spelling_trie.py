"""Spelling variants: words one edit apart, found by walking a relational trie.

The words, and the words read backwards, are two tries in one distributed table: a row per node with its edges, each labelled
with the code points up to the next node (a prefix that branches, ends a word or starts a walk). The frontier holds
``(word, position, node, edits)``. A word starts with no edits at the node of its first half, which spells exactly that half,
and each level joins all states with their nodes' edges: an edge that spells the next code points is followed; from a state
without edits every other edge is entered by replacing, inserting or deleting one code point. A state with one edit that has
used up its word at the end of another one names a neighbour. An edit in the second half is found in the trie of the words,
one in the first half in that of the reversed words, so no state is ever at the root or at the few nodes below it.

Since a word's own edge leads to its own next node, two words part only at nodes: every neighbour is met with the edit at the
first place where the two differ. Nodes have one row each, with at most as many edges as there are letters; the join goes
through ``lookup_join``, which spreads the states of a node that many words share.

Prefixes beyond ``PLAIN`` code points stand for themselves by their SHA-256, so long words take linear space.

Null and empty texts give no words. A null id counts as empty in the hash that misspells. Repeated rows count each time; ties
between forms go to the smaller word in code-point order. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup_join, settle
from .common import lower_ascii, text_of

# Fixed value: the letters that words are made of.
RUN = "[A-Za-z\\x{C0}-\\x{FF}]+"
PLAIN = 40


def from_position(text: Column, start: Column) -> Column:
    """``text`` from a 0-based position on."""
    return F.substring(text, start + 1, F.length(text))


def runs(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``doc, run`` of every maximal run of letters, with A-Z lower-cased."""
    found = F.regexp_extract_all(lower_ascii(text_of(F.col(text))), F.lit(RUN), F.lit(0))
    return docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))


def misspelled(doc: Column, run: Column, every: int) -> Column:
    """The run, without one code point where ``every`` divides the hash of document and run."""
    h = F.crc32(F.encode(F.concat_ws(":", doc, run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), from_position(run, at + 1))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, id: str, text: str, every: int, shortest: int, rarest: int) -> DataFrame:
    """``word, n`` of the words of at least ``shortest`` code points and ``rarest`` occurrences."""
    words = runs(docs, id, text).where(F.length("run") >= shortest).select(misspelled(F.col("doc"), F.col("run"), every).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


def key_of(word: Column, depth: Column) -> Column:
    prefix = F.substring(word, F.lit(1), depth)
    return F.when(depth <= PLAIN, prefix).otherwise(F.sha2(F.encode(prefix, "UTF-8"), 256))


def directed(words: DataFrame) -> DataFrame:
    """``back, path, size, half`` of every word, read forwards and backwards."""
    ways = F.array(*[F.struct(F.lit(b).alias("back"), w.alias("path")) for b, w in enumerate((F.col("word"), F.reverse("word")))])
    both = words.select(F.explode(ways).alias("way")).select("way.back", "way.path")
    return both.withColumn("size", F.length("path")).withColumn("half", F.floor(F.col("size") / 2).cast("int"))


def trie(words: DataFrame) -> DataFrame:
    """``back, node, edges``: of every node its edges ``(label, child, word)``; ``word`` is the path that ends at the child.

    A word is entered from the depth at which a neighbour one code point shorter can start.
    """
    depths = F.sequence(F.floor((F.col("size") - 1) / 2).cast("int"), F.col("size"))
    prefixes = directed(words).withColumn("depth", F.explode(depths)).withColumn("node", key_of(F.col("path"), F.col("depth")))
    prefixes = settle(prefixes, "prefixes")
    after = F.substring("path", F.col("depth") + 1, F.lit(1))
    stop = F.max((F.col("depth") == F.col("size")) | (F.col("depth") == F.col("half")))
    nodes = prefixes.groupBy("back", "node").agg(F.min(after).alias("low"), F.max(after).alias("high"), stop.alias("stop"))
    nodes = nodes.where(F.col("stop") | (F.col("low") != F.col("high"))).select("back", "node")
    own = lookup_join(prefixes, nodes, ["back", "node"], "left_semi")
    paths = own.groupBy("back", "path", "size").agg(F.array_sort(F.collect_list("depth")).alias("depths"))
    steps = F.zip_with("depths", F.slice("depths", 2, F.size("depths")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    steps = paths.withColumn("step", F.explode(F.filter(steps, lambda s: s.b.isNotNull()))).select("back", "path", "size", "step.a", "step.b")
    ended = F.max(F.when(F.col("b") == F.col("size"), F.col("path")))
    label = F.substring("path", F.col("a") + 1, F.col("b") - F.col("a"))
    edges = steps.groupBy("back", key_of(F.col("path"), F.col("a")).alias("node"), label.alias("label"), key_of(F.col("path"), F.col("b")).alias("child")).agg(ended.alias("word"))
    return edges.groupBy("back", "node").agg(F.collect_list(F.struct("label", "child", "word")).alias("edges"))


def step(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every way on from every state: ``back, path, at, node, edits, near``; ``near`` is a neighbour's path, else null."""
    met = lookup_join(frontier, nodes, ["back", "node"], settled=True)
    met = met.select("back", "path", "at", "edits", from_position(F.col("path"), F.col("at")).alias("rest"), F.inline("edges"))
    label, rest, size = F.col("label"), F.col("rest"), F.length("label")
    tail, skipped = from_position(label, F.lit(1)), from_position(rest, F.lit(1))
    left = F.length(rest) > 0

    # The edges of a node differ in their first code point, so at most one of them follows the word.
    fresh = (F.col("edits") == 0) & (F.substring(rest, 1, 1) != F.substring(label, 1, 1))
    follows = F.startswith(rest, label)
    replaces, inserts, deletes = left & F.startswith(skipped, tail), F.startswith(rest, tail), left & F.startswith(skipped, label)
    # Most edges lead no way on; they go before the ways are listed.
    met = met.where(follows | (fresh & (inserts | replaces | deletes)))

    def way(allowed: Column, used: Column, edits: Column) -> Column:
        return F.when(allowed, F.struct(used.alias("used"), edits.cast("int").alias("made")))

    ways = F.array(
        way(follows, size, F.col("edits")),
        way(fresh & replaces, size, F.lit(1)),
        way(fresh & inserts, size - 1, F.lit(1)),
        way(fresh & deletes, size + 1, F.lit(1)),
    )
    gone = met.select("back", "path", "at", "child", "word", F.inline(ways)).where("made IS NOT NULL")
    gone = gone.select("back", "path", (F.col("at") + F.col("used")).alias("at"), F.col("child").alias("node"), F.col("made").alias("edits"), F.col("word").alias("ended"))
    unused = F.length("path") - F.col("at")
    # With one code point left and no edit so far, deleting it ends the walk here.
    return gone.withColumn("near", F.when(unused == F.when(F.col("edits") == 0, 1).otherwise(0), F.col("ended"))).drop("ended")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near``: every ordered pair of different words one inserted, deleted or replaced code point apart."""
    nodes = settle(trie(words), "trie")
    states = directed(words).select("back", "path", F.col("half").alias("at"), key_of(F.col("path"), F.col("half")).alias("node"), F.lit(0).alias("edits"))
    met = []
    while True:
        level = settle(step(states, nodes), "frontier")
        met.append(level.where("near IS NOT NULL").select("back", "path", "near"))
        # A state that has used its word up can only go on by inserting, so only without edits.
        states = level.where("edits = 0 OR at < length(path)").drop("near")
        if states.isEmpty():
            break
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionAll(more)
    forward = lambda c: F.when(F.col("back") == 1, F.reverse(c)).otherwise(F.col(c))
    return pairs.select(forward("path").alias("word"), forward("near").alias("near")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form (``word, form``): the end of the chain of forms, by doubling."""
    chain = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = settle(lookup_join(chain, on, ["root"], "left", settled=False).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        chain = after.select("word", "root")
        if after.where("moved").isEmpty():
            return chain


def variants(docs: DataFrame, id: str, text: str, every: int = 199, shortest: int = 6, rarest: int = 5, times: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word (see the module).

    ``form`` is the neighbour of largest ``n``, if that is at least ``times`` the word's own; ``root`` follows forms to the
    last, and is the word itself without one.
    """
    words = settle(vocabulary(docs, id, text, every, shortest, rarest), "vocabulary")
    pairs = settle(neighbours(words.select("word")), "pairs")
    counted = lookup_join(pairs, words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), ["near"])
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = settle(counted.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "near")
    joined = settle(words.join(near, "word", "left"), "joined")
    formed = -F.col("best.n") >= times * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n"))
    chains = roots(joined.where("form IS NOT NULL"))
    return joined.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(every: int, shortest: int, rarest: int, times: int) -> str:
    """The same rows in SQL over ``documents (doc_id, text)``; words meet by what is left of them without one code point."""
    # One bit of the reflected CRC-32 at a time.
    bit = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    return f"""WITH RECURSIVE bits AS (
            SELECT b, b::BIGINT AS r, 0 AS i FROM range(256) t(b)
            UNION ALL SELECT b, {bit.format("r")}, i + 1 FROM bits WHERE i < 8),
        crc AS MATERIALIZED (SELECT list(r ORDER BY b) AS t FROM bits WHERE i = 8),
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        each_run AS MATERIALIZED (
            SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS named, count(*) AS n FROM runs
            WHERE length(run) >= {shortest} GROUP BY ALL),
        hashed AS MATERIALIZED (
            SELECT run, n, xor(list_reduce(
                list_transform(range(0, octet_length(encode(named))::BIGINT * 2, 2), lambda i: ('0x' || substr(hex(encode(named)), i + 1, 2))::BIGINT),
                lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295), 4294967295) AS h FROM each_run, crc),
        words AS MATERIALIZED (
            SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT n, CASE WHEN h % {every} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
            WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {rarest}),
        without AS MATERIALIZED (
            SELECT DISTINCT word, n, i, left(word, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
        pairs AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
        near AS (SELECT word, count(*) AS n_near, min({{'n': -near_n, 'near': near}}) AS best FROM pairs GROUP BY word),
        formed AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= {times} * w.n THEN best.near END AS form,
                CASE WHEN -best.n >= {times} * w.n THEN -best.n END AS form_n
            FROM words w LEFT JOIN near USING (word)),
        chain AS (
            SELECT word, word AS root, 0 AS hops FROM formed
            UNION ALL SELECT c.word, f.form, hops + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT word, form, arg_max(root, hops) AS root, n, n_near, form_n FROM formed JOIN chain USING (word) GROUP BY ALL"""
