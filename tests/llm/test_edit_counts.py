from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from derlem.llm import edit_counts as e
from derlem.llm.tokens import SPECIAL, encoder

count = lambda text: len(encoder()(text)) // 4
alphabet = st.lists(st.sampled_from([*"ab '\n\tslre1é.-", SPECIAL, SPECIAL[:7], SPECIAL[7:], "<|", "|>"]), max_size=60).map("".join)


def sound(tree):
    size = len(tree.chars) // 2
    assert all(tree.chars[k] == tree.chars[2 * k] + tree.chars[2 * k + 1] and tree.tokens[k] == tree.tokens[2 * k] + tree.tokens[2 * k + 1] for k in range(1, size))
    assert tree.chars[1] == len(tree.text) and tree.total == count(tree.text)


@settings(max_examples=600, deadline=None)
@given(alphabet, st.lists(st.tuples(st.integers(0, 120), st.integers(0, 20), st.lists(st.sampled_from([*"ab '\ns.1 ", SPECIAL, SPECIAL[:7], SPECIAL[7:]]), max_size=8).map("".join)), max_size=5), st.integers(1, 3))
def test_counts_after_edits_are_those_of_the_whole_text(text, edits, leaf):
    tree = e.Tree(text, encoder(), leaf)
    sound(tree)
    want = text
    for start, removed, inserted in edits:
        start = min(start, len(want))
        want = want[:start] + inserted + want[start + removed :]
        tree.edit(start, removed, inserted)
        assert tree.text == want
        sound(tree)


def test_an_edit_touches_little(spark):
    text = "some words of a text, and more. " * 3000
    tree = e.Tree(text, encoder())
    assert tree.edit(50_000, 3, "new") < 2000
    assert tree.edit(50_000, 0, "x " * 9000) >= 18_000
    sound(tree)


def test_query_against_force(spark, sf):
    docs = {r.doc_id: (r.text or "", r.e) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", e.stated_edits().alias("e")).collect()}
    rows = e.op10_edit_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text, edits = docs[r.doc_id]
        assert r.n_before == count(text)
        for x in edits:
            start = min(x.start, len(text))
            text = text[:start] + x.inserted + text[start + x.removed :]
        assert (r.n_after, r.n_chars) == (count(text), len(text))
    assert sum(r.n_encoded for r in rows) < 3 * sum(r.n_chars for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "a b"), (None, "x y"), (3, "w " * 60000)], "doc_id long, text string").withColumn("chars", F.lit("clash"))
    edits = spark.createDataFrame([(2, 1, 0, 0, "b "), (2, 0, 5, 9, "a"), (9, 0, 0, 0, "z"), (None, 0, 0, 0, "n"), (3, 0, 100, 1, None)], "doc_id long, position int, start int, removed int, inserted string")
    got = sorted((r.doc_id or -1, r.text if len(r.text or "") < 99 else len(r.text), r.tokens[1]) for r in e.apply_edits(e.attach_edits(e.build_trees(docs), edits)).collect())
    assert got == [(-1, "x y", 2), (1, "", 0), (2, "b a", count("b a")), (2, "b a ba", count("b a ba")), (3, 119999, count("w " * 50 + " " + "w " * 59949))]
    assert e.build_trees(docs.limit(0)).count() == 0


def slow(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_a_leaf_is_never_cut_inside_the_special_token():
    tree = e.Tree("ab " * 62 + SPECIAL + " cd" * 80, encoder())
    sound(tree)
    assert tree.total == len(slow(tree.text))
    tree.edit(62 * 3 + 5, 1, "X")
    sound(tree)
    tree.edit(62 * 3 + 5, 1, "d")
    sound(tree)
    assert tree.total == len(slow(tree.text))


def test_encoder_on_long_gaps():
    import array

    ids = lambda text: array.array("I", encoder()(text)).tolist()
    for text in (" " * 20_000, "a" + " " * 20_000 + "b", "\n" * 20_001 + "'s", "x " + " \n" * 9_000 + "\u3000y" + "\t" * 10_000 + "z ", SPECIAL + " " * 12_000 + "c"):
        assert ids(text) == slow(text)
    for gap in (" ", "\n", " \n"):
        assert len(ids("a" + gap * 1_200_000 + "b")) > 2


def test_long_gaps_in_trees(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_200_000 + "b"), (2, "c")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 0, 600_000, 0, "x"), (2, 0, 1, 0, "\n" * 1_100_000)], "doc_id long, position int, start int, removed int, inserted string")
    got = {r.doc_id: r for r in e.apply_edits(e.attach_edits(e.build_trees(docs), edits)).collect()}
    assert got[1].tokens[1] == count(got[1].text) and got[2].tokens[1] == count(got[2].text)
