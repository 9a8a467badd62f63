"""The filter of aliases: nothing that names a child is lost, and little else passes."""

import random

from sessionloom.operators import trajectory as T


def screened(spark, texts, children, most_words):
    read = spark.createDataFrame(
        [(s, i, "c", [], [t]) for i, (s, t) in enumerate(texts)], "session string, step int, call_id string, ids array<string>, texts array<string>"
    )
    aliases = T.child_aliases(spark.createDataFrame([(s, "codex", c) for s, c in children], "session string, source string, child_id string"))
    return {(r.session, r.step): (set(r.tokens), set(r.signs)) for r in T.screen_results(read, aliases, most_words).collect()}


def test_no_alias_is_lost_and_few_words_pass(spark):
    draw = random.Random(3)
    words = [f"{draw.getrandbits(60):x}" for _ in range(20_000)]
    children = [("many", w) for w in words[:3000]] + [("few", w) for w in words[3000:3003]] + [("few", "odd/anchors")]
    texts = [("many", " ".join(words[k::20])) for k in range(20)] + [("few", " ".join(words[2990:9000]) + " anchors"), ("none", words[0])]
    for most_words, share in ((T.FILTER_WORDS, 0.02), (1, 1.0)):
        got = screened(spark, texts, children, most_words)
        assert ("none", 21) not in got
        many = set().union(*[got["many", k][0] for k in range(20)])
        assert many >= set(words[:3000]) and len(many) - 3000 <= share * 17_000
        few = got["few", 20][0]
        assert few >= {*words[3000:3003], "anchors"} and len(few) - 4 <= share * 6007


def test_odd_rows_of_the_filter(spark):
    texts = [("s", ""), ("s", "!"), ("s", "a a a"), (None, "a")]
    got = screened(spark, texts, [("s", "!?"), ("s", "a"), ("s", "a"), (None, "a")], T.FILTER_WORDS)
    assert got == {("s", 0): (set(), set()), ("s", 1): (set(), {"!"}), ("s", 2): ({"a"}, set())}
    assert screened(spark, texts, [], T.FILTER_WORDS) == {}
    long = [("s", "x " * 200_000 + "a")]
    assert screened(spark, long, [("s", "a")], T.FILTER_WORDS)["s", 0][0] == {"a"}
