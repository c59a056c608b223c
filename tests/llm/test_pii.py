import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from orderlens.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    """The four patterns as they are written, by the regular expression engine."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if [True, all(int(p) < 256 for p in m.group().split(".")) if kind == 1 else True, 16 <= len(d) <= 19 and luhn(d), 8 <= len(d) <= 15][kind]:
                out.append((kind, *m.span()))
    return out


def test_plain_finds_equal_the_patterns():
    r = random.Random(4)
    pieces = ["a@b.c", "x.y+z@", "@", "mail-1.example.com", "_", " ", "-", ".", "+", "+1 (555) 555-0134", "4532015112830366", "4532 0151-1283 0366", "(", "0",
              "255", "256", "1.2.3.4", "000300.1.1.001", "é", "x", "  "]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 14)))
        assert pii.detect(text) == base(text), text


DISGUISED = [
    ("email", "<john.doe [at] example [dot] com>"), ("email", "<john dot doe at mail dot example dot com>"), ("email", "<john(at)example.com>"),
    ("email", "<jоhn@example.com>"), ("email", "<jo​hn@example.com>"), ("email", "<john @ example . com> or so"), ("email", "<john-at-example-dot-com>"),
    ("email", "<john&#64;example&#46;com>"), ("email", "<ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ>"), ("email", "<anna punkt schmidt ät beispiel punkt de>"),
    ("email", "<juan arroba ejemplo punto es>"), ("email", "<john{at}example{dot}co{dot}uk>"),
    ("phone", "call <plus one five five five five five five zero one three four> now"), ("phone", "<+1 (five five five) five-five-five zero one three four>"),
    ("phone", "<+1 (5O5) 555-Ol34>"), ("phone", "<+１ (５５５) ５５５-０１３４>"), ("phone", "<+1 (555) 555–0134>"), ("phone", "<+٤٩ ١٥١ ٢٣٤٥٦٧٨>"),
    ("ip", "<one nine two dot one six eight dot one dot one>"), ("ip", "<192[.]168[.]1[.]1>"), ("ip", "<192 dot 168 dot 1 dot 1>"),
    ("card", "pay <4532 zero one five one 1283 0366> then"), ("card", "<４５３２ ０１５１ １２８３ ０３６６>"), ("card", "<4532 O151 1283 O366>"),
    ("card", "<vier fünf drei zwei null eins fünf eins eins zwei acht drei null drei sechs sechs>")]


@pytest.mark.parametrize("kind,marked", DISGUISED)
def test_disguises_lead_back_to_their_place(kind, marked):
    for before, after in (("", ""), ("Größe 12 é – ", " und so."), ("ｗｉｄｅ ​", " zero one"[:0])):
        text = before + marked.replace("<", "").replace(">", "") + after
        start = len(before) + marked.index("<")
        end = len(before) + marked.index(">") - 1
        plain, added = pii.spans(text)
        assert [(pii.KINDS[k], text[a:b]) for k, a, b in added] == [(kind, text[start:end])]
        assert plain == base(text)


@pytest.mark.parametrize("text", [
    "look at the dot on the page", "meet me at example.com today", "+1 (017) 555-7713 un homme", "+1 (017) 555-7713 – 5 things", "six of one, half a dozen",
    "in at the.72@mail3.example.com then", "(a) first (b) second", "version 1.2.3 at point 4", "un six neuf", "l'été à 10 heures", "0O0O token b44e15e09fd311c3", "5 - 6 = 7"])
def test_clean_text_stays(text):
    assert pii.spans(text)[1] == [] and pii.spans(text)[0] == base(text)


def test_places_of_edits():
    r = random.Random(2)
    for _ in range(300):
        source = "".join(r.choice("abcdef") for _ in range(20))
        edits, at = [], 0
        while at < 18:
            a = r.randint(at, 19)
            b = r.randint(a + 1, min(20, a + 3)) if a < 20 else a
            edits.append((a, b, r.choice(["", "X", "YZ"])))
            at = b + 1
        e = pii.Edited(source, edits)
        owner = []  # the source run of each symbol
        done = 0
        for a, b, new in edits:
            owner += [(i, i + 1) for i in range(done, a)] + [(a, b)] * len(new)
            done = b
        owner += [(i, i + 1) for i in range(done, len(source))]
        assert len(owner) == len(e.text)
        for i in range(len(owner)):
            for j in range(i + 1, len(owner) + 1):
                assert e.source_span(i, j) == (owner[i][0], owner[j - 1][1])


def test_long_runs_take_linear_time():
    n = 300_000
    for text in ("a" * n, "1" * n, "1 " * n, "a." * n, "+1" + " " * n, "@" * n, "a@" * n, "five " * (n // 5), "a at b dot " * (n // 10), "1.1." * n, "l" * n, "(at)" * (n // 4)):
        pii.spans(text)


def test_rows(odd_docs, no_docs):
    docs = odd_docs.withColumns({"base": F.lit(1), "added": F.lit("x"), "id": F.lit(3), "spans": F.lit(0)})
    rows = pii.find(docs).collect()
    assert len(rows) == docs.count() and all(x.base == [] and x.added == [] for x in rows)
    assert pii.find(no_docs).count() == 0


def test_masking_and_joining(spark):
    text = "jоhn@example.com, é 10.0.0.1 and +1 (555) 555-0134"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = pii.find(df).withColumn("every", pii.merged(F.col("base"), F.col("added")))
    out = {x.doc_id: x for x in found.join(df, "doc_id").select("doc_id", pii.joined(F.col("every")).alias("spans"), pii.joined(F.col("base")).alias("plain"),
                                                                pii.masked(F.col("text"), F.col("every")).alias("masked")).collect()}
    assert out[1].spans == "email:0:16,email:2:16,ip:20:28,phone:33:50" and out[1].plain == "email:2:16,ip:20:28,phone:33:50"
    assert out[1].masked == "[email], é [ip] and [phone]" and out[2].spans == "" and out[2].masked == ""
    assert hashlib.sha256(b"").hexdigest()
