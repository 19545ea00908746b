import pytest

from derlem.functions import query as q


@pytest.mark.parametrize(("text", "want"), [
    ('"kira tespit davasi', '"kira tespit davasi"'),
    ("tahliye ihtarname", "tahliye* AND ihtarname*"),
    ("tahliye -ticari", "tahliye* NOT ticari*"),
    ("(kira OR tahliye) AND fesih", "( kira* OR tahliye* ) AND fesih*"),
    ("or a and", "a*"),
    ("a AND -b", "a* AND b*"),
    ("a) (b", "a* ( b* )"),
    ("-a", "NOT a*"),
    ("", ""),
])
def test_normal_form(text, want):
    assert q.normalise(text) == want


def test_not_binds_before_and_before_or():
    assert q.parse("a* OR b* AND c* NOT d*", q.fold_words).expression == ("OR", 0, ("AND", 1, ("NOT", 2, 3)))


@pytest.mark.parametrize("text", ["NOT a*", "a* ( b* )", "", "( a*"])
def test_what_is_not_valid(text):
    with pytest.raises(q.QuerySyntaxError):
        q.parse(text, q.fold_words)
