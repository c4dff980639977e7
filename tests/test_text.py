import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, ""),
        ("", ""),
        ("<p>A <b>bold</b> claim</p>", "A bold claim"),
        ("see https://a.example/x?y=1 now", "see now"),
        ("mail me@site.org, or call", "mail or call"),
        ("@handle stays, a@b@c goes, end@", "@handle stays, goes, end@"),
        ("many    blanks\t\n here", "many blanks here"),
        ("if 5 < 6 and 7 > 3", "if 5 3"),
        ("bell\x07 and\x01 null", "bell and null"),
        ("a\u00a0\u2003b\u3000c\x1cd", "a b c d"),
    ],
)
def test_clean_text(one, text, expected):
    assert one(text, T.clean_text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("cafÃ© dâ€™Ã©tÃ©", "café d'été"),
        ("plain été stays", "plain été stays"),
        ("price Â£5 中", "price Â£5 中"),
        ("&eacute;&amp;&#233;&#xE9;&#99999999;", "é&éé&#99999999;"),
        ("<b>&amp;</b>", "<b>&amp;</b>"),
        ("ﬁnd “it” oﬀ", 'find "it" off'),
        ("a\r\nb\rc\u2028d", "a\nb\nc\nd"),
    ],
)
def test_fix_encoding(one, text, expected):
    assert one(text, T.fix_encoding) == expected


def test_normalize_text(one):
    assert one(" \u00a0it\u2019s \u201cfine\u201d\u2003now ", T.normalize_text) == "it's \"fine\" now"


def test_page_text_order_of_replacements(one):
    # `&amp;lt;` becomes `&lt;` first and then `<`.
    assert one(" a&nbsp;b &amp;lt; c ", T.clean_page_text) == "a b < c"


def test_hash_is_sha256_of_title_bar_abstract(one):
    import hashlib

    assert one("été", lambda c: T.content_hash(c, F.lit("x"))) == hashlib.sha256("été|x".encode()).hexdigest()


def test_truncation_counts_characters(one):
    assert one("éééé", lambda c: T.truncate_marked(c, 3)) == "ééé..."
    assert one("ééé", lambda c: T.truncate_marked(c, 3)) == "ééé"
    with pytest.raises(ValueError):
        T.truncate_marked(F.lit("x"), 0)


def test_measures(one):
    assert one("aé bü", T.ascii_ratio) == pytest.approx(3 / 5)
    assert one(" a b\nc\u3000d ", T.word_count) == 4


@pytest.mark.parametrize(
    "text, expected",
    [('Sure: {"a": {"b": 1}} done', '{"a": {"b": 1}}'), ("} {", ""), ("none", ""), ("{\n}", "{\n}")],
)
def test_json_slice(one, text, expected):
    assert one(text, T.json_object_slice) == expected


def test_slug_url_and_consent(one):
    assert one("Type 2 Fever", T.topic_slug) == "type_2_fever"
    assert one("12", T.article_url).endswith("/12/") and one("", T.article_url) == ""
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    record = one("https://x.example", lambda c: T.compliance_metadata(c, at, robots_checked=False))
    assert record["robots_txt_checked"] == "no" and record["timestamp"] == "2024-01-02T03:04:05" and len(record) == 6
    assert one("u", lambda c: T.compliance_metadata(c, at, enabled=False)) == {}
