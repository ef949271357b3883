"""Splitters, scorers, markup and tokens against plain Python."""

from __future__ import annotations

import io
import re
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from loomwork.errors import ConfigError
from loomwork.functions import markup, score, text, tokens
from pyspark.sql import functions as F

STRINGS = st.lists(st.text(alphabet=st.sampled_from(list("ab.!? \n\r\t  　\u0085\x1cÉß🙂-,1")), max_size=40), min_size=5, max_size=60)
FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, texts, c):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", c).collect())]


def kept(pieces):
    return [p.strip() for p in pieces if p.strip()]


@FEW
@given(STRINGS)
def test_paragraphs(spark, texts):
    assert column(spark, texts, text.ParagraphSplit().column(F.col("t"))) == [kept(re.split(r"\r?\n\s*\r?\n", t)) for t in texts]


@FEW
@given(STRINGS, st.integers(1, 4), st.integers(1, 4))
def test_sentence_windows(spark, texts, window, stride):
    def plain(t):
        s = [x for x in re.split(r"(?<=[.!?])\s+", t) if x.strip()]
        return kept(" ".join(x.strip() for x in s[i : i + window]) for i in range(0, len(s), stride))

    assert column(spark, texts, text.FixedWindowSplit(window, stride).column(F.col("t"))) == [plain(t) for t in texts]


@FEW
@given(STRINGS, st.sampled_from(["\n", "-", r"(?<=[.!?])\s+", r"(-)|(,)", r"[ab]+", ","]))
def test_patterns(spark, texts, pattern):
    want = [kept(p for p in re.split(pattern, t) if p) for t in texts]
    assert column(spark, texts, text.RegexSplit(pattern).column(F.col("t"))) == want


@FEW
@given(STRINGS)
def test_strip(spark, texts):
    assert column(spark, texts, text.strip(F.col("t"))) == [t.strip() for t in texts]


def test_null_text_has_no_pieces(spark):
    for s in (text.ParagraphSplit(), text.FixedWindowSplit(2, 1), text.RegexSplit("a"), text.RegexSplit("(a)")):
        assert column(spark, [None], s.column(F.col("t"))) == [None]


def test_splitters_by_name():
    assert text.splitter(None) is None and text.splitter({"type": "None"}) is None
    assert text.splitter({"type": "FixedWindowSplit", "window": 3}) == text.FixedWindowSplit(3, 5)
    assert text.splitter({"type": "RegexSplit"}).pattern == "\n\n"
    for s in (text.ParagraphSplit(), text.FixedWindowSplit(4, 2), text.RegexSplit("x")):
        assert text.splitter(s.to_dict()) == s
    for bad in ({"type": "Other"}, {"type": "RegexSplit", "pattern": "("}, {"type": "FixedWindowSplit", "window": 0}):
        with pytest.raises(ConfigError):
            text.splitter(bad)


def test_own_splitter(spark):
    assert column(spark, ["a b", None], text.UdfSplit(str.split).column(F.col("t"))) == [["a", "b"], None]


@FEW
@given(STRINGS)
def test_keyword_scores(spark, texts):
    s = score.KeywordScorer(("A.", "É", "b b"))
    assert column(spark, texts, s.column(F.col("t"))) == [float(any(k in t.lower() for k in ("a.", "é", "b b"))) for t in texts]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ", max_size=9), st.text(alphabet="abcd ", max_size=14))
def test_partial_ratio_is_the_best_window(a, b):
    if not a or not b:
        want = 100.0 if a == b else 0.0
    else:
        s, t = (a, b) if len(a) <= len(b) else (b, a)
        m = len(s)
        windows = {t[max(0, i) : i + m] for i in range(1 - m, len(t))}
        want = max(200 * lcs(s, w) / (m + len(w)) for w in windows)
    assert score.partial_ratio(a, b) == pytest.approx(want)


def test_fuzzy_scores_in_spark(spark):
    got = column(spark, ["A Question of time", "a qestion", "zzz", None], score.FuzzyScorer(("question",)).column(F.col("t")))
    assert got[0] == 1.0 and got[1] == pytest.approx(score.partial_ratio("a qestion", "question") / 100) and got[2] == 0.0 and got[3] is None


def test_scorers_by_name():
    assert score.scorer({}) is None
    assert score.scorer({"type": "KeywordScorer", "keywords": ["A"]}).keywords == ("a",)
    for bad in ({"type": "KeywordScorer", "keywords": []}, {"type": "Else"}):
        with pytest.raises(ConfigError):
            score.scorer(bad)


def test_html_text():
    html = "<html><head><style>p{}</style></head><body><!-- no --><h1>A &amp; B</h1><p>one <b>two</b></p><script>x</script></body></html>"
    assert markup.html_to_text(html) == "A & B\none \ntwo"
    assert markup.html_to_text(None) is None and markup.html_to_text("") == ""


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('first')}{p(' ')}<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>{p('second')}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p('top')}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {w}>{p('bottom')}</w:ftr>")
    return raw.getvalue()


def test_docx_text():
    assert markup.docx_to_text(docx()) == "top\nfirst\nsecond\ncell\nbottom"


def test_tokens(spark):
    got = column(spark, ["abcd", "abcde", "", None], tokens.approx_tokens(F.col("t")))
    assert got == [1, 2, 0, None]
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    t = Tokenizer.from_file(path)
    texts = ["Hello there, world", "", "naïve ünïcode"]
    assert column(spark, [*texts, None], tokens.exact_tokens(F.col("t"), path)) == [*[len(t.encode(x).ids) for x in texts], None]


def test_texts_are_tokenized_in_runs():
    from loomwork.functions.tokens import _runs

    texts = ["a" * n for n in (3, 4, 20, 0, 5, 5, 1)]
    runs = list(_runs(texts, 10))
    assert sum(runs, []) == texts and [[len(t) for t in r] for r in runs] == [[3, 4], [20], [0, 5, 5], [1]] and list(_runs([])) == []
