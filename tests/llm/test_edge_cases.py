"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for all ten operators."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import (
    chat_format,
    decontaminate,
    html_extract,
    language_id,
    line_dedup,
    ngram_join,
    quality_rules,
    queries,
    sentencepiece_codec,
    suffix_dedup,
    url_filters,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, rk string, n_words string, label string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def fixture_rows():
    rng = random.Random(9)
    base, long = words(rng, 120), words(rng, 12000)
    near = base.replace(base.split()[60], "changed")
    texts = [
        None, "", "   \n\t ", "one two", "ONE two", base, base, near, long, long + " tail", "é" * 300, "a" * 500, base + "\n" + words(rng, 60),
        "x\n\nx\nX!\n" + words(rng, 30) + "\n" + words(rng, 30), words(rng, 5), words(rng, 300) + base[:250] + words(rng, 100),
    ]
    rows = [(k, t, "en", "s", len(t or ""), "h", "r", "w", "l") for k, t in enumerate(texts)]
    return [*rows, rows[5], (3, base, None, None, None, None, None, None, None), (None, base, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_removed(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 60])
def test_suffix_dedup(docs, nothing, length):
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(docs, length))
    rows = [(r[0], r[1]) for r in fixture_rows()]
    want = [(i, *x) for (i, _), x in zip(rows, brute_removed([(t or "").encode() for _, t in rows], length))]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_splits_a_hot_passage(spark):
    rng = random.Random(3)
    passage = words(rng, 90)
    rows = [(k, f"{words(rng, rng.randint(5, 40))} {passage if k % 3 else passage[:180]} {words(rng, 20)}") for k in range(150)]
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    want = [(i, *x) for (i, _), x in zip(rows, brute_removed([t.encode() for _, t in rows], 200))]
    assert sorted(map(tuple, got.collect())) == want


def test_line_dedup(spark, docs, nothing):
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == docs.count() and set(got[0].asDict()) == set(docs.columns) | {"n_lines", "n_removed"}
    by = {r["doc_id"]: r for r in got if r["doc_id"] in (4, 6, 7, 12, 13)}
    assert by[4]["text"] == "" and by[6]["text"] == "" and by[7]["n_removed"] == 1  # equal, equal, one word apart
    assert by[12]["n_removed"] == 1 and by[12]["text"].startswith("".join(fixture_rows()[12][1].split("\n")[1][:20]))
    assert by[13]["text"].split("\n")[:2] == ["x", ""] and by[13]["n_removed"] == 2
    kept = [line for r in got for line in {r["text"] or ""} for line in line.split("\n") if line.strip()]
    assert len(kept) == len(set(kept)) + sum(1 for k, n in collections.Counter(kept).items() if n > 1 and k.startswith(fixture_rows()[5][1][:20]))
    assert line_dedup.dedup_lines(nothing).count() == 0
    more = docs.withColumns({"N_Lines": F.lit(7), "rest": F.lit("r"), "LK": F.lit(1), "a.b": F.lit(2)})
    wide = line_dedup.dedup_lines(more)
    assert wide.columns == [*docs.columns, "rest", "LK", "a.b", "n_lines", "n_removed"]
    assert sorted(map(str, wide.drop("rest", "LK", "`a.b`").select(got[0].__fields__).collect())) == sorted(map(str, got))


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup_finds_every_link_by_edits(spark):
    """The links are those of all pairs by word edits: one, two and more edits, repeated words, all lengths."""
    rng = random.Random(11)
    rows, vocabulary = [], words(rng, 25).split()
    for k in range(120):
        base = [rng.choice(vocabulary) if k % 3 == 0 else words(rng, 1) for _ in range(rng.choice([4, 5, 6, 8, 9, 10, 11, 14, 15, 19, 20, 30, 50]))]
        other = [*base]
        for _ in range(rng.randint(0, len(base) // 4 + 1)):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 1)] = [f"q{rng.randrange(999)}z"] * rng.randint(0, 1)
        rows += [(2 * k, " ".join(base) + " repeatedending"), (2 * k + 1, " ".join(other) + " repeatedending")]
    long = words(rng, 31000).split()
    rows += [(900, " ".join(long)), (901, " ".join([*long[:500], "changed", *long[501:]]))] + [(902, words(rng, 30))] * 3
    forms = [(i, " ".join(t.split()).translate(str.maketrans("123456789", "000000000"))) for i, t in rows if i < 900]
    parent = {i: i for i, _ in forms}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in forms:
        for j, b in forms:
            x, y = a.split(), b.split()
            if i < j and (a == b or word_edits(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert {i: got[i] for i in parent} == {i: int(root(i) != i) for i in parent}
    assert sum(got[i] for i in parent) > 60 and (got[900], got[901], got[902]) == (0, 1, 0)


def shingles(text):
    found = ngram_words(text)
    return frozenset(tuple(found[k : k + 5]) for k in range(len(found) - 4)) if len(found) >= 5 else frozenset([tuple(found)] if found else [])


def ngram_words(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))


def test_ngram_join(docs, nothing):
    rows = [(r[0], r[1]) for r in fixture_rows() if r[0] is not None and not (r[0] == 3 and r[2] is None)]
    some = docs.where("doc_id IS NOT NULL AND NOT (doc_id = 3 AND lang IS NULL)")
    assert sorted(map(tuple, ngram_join.join_components(some).collect())) == brute_components(rows)
    assert ngram_join.join_components(docs).count() == docs.count()
    assert ngram_join.join_components(nothing).count() == 0


def test_ngram_join_of_many_near_copies(spark):
    rng = random.Random(12)
    rows, bases = [], [words(rng, 60).split() for _ in range(6)]
    passage = words(rng, 25)
    for k in range(220):
        text = [*bases[k % 6]]
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(60)] = f"q{rng.randrange(9)}"
        rows.append((k, " ".join(text) + (f" {passage}" if k % 2 else "")))
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_sentencepiece(spark, docs, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    rng = random.Random(5)
    odd = ["".join(rng.choice(" ▁ab\n\té<s>😀　ﬁ\x00I") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["  a  b ", "▁▁ x", " ", "▁"]
    for frame in (docs, spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")):
        texts = [(r["doc_id"], r["text"]) for r in frame.collect()]
        want = sorted((str(i), sp.encode(t) if t else [], sp.decode(sp.encode(t)) if t else "") for i, t in texts)
        got = sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in sentencepiece_codec.encode_decode(frame, queries.model_path(), max_chunks=50).collect())
        assert got == want
    assert sentencepiece_codec.encode_decode(nothing, queries.model_path()).count() == 0


def test_chat_format(spark):
    rng = random.Random(6)
    bits = ["</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "[", "é", "😀", "a b", "\n", "<\\", "<<ROLE>>", " [/INST] "]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) if rng.random() > 0.1 else None
            rows.append((c, t, rng.choice(["user", "assistant", "system", "to[o<l", "", None]), text, 1))
    rows += [(61, 0, "user", "x", 1), (61, 0, "user", "x", 1), (61, 0, "assistant", "y", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(5)
    made = chat_format.format_conversations(turns)
    parsed = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t, role or "", role is not None, text or "", text is not None))
    assert set(parsed) == set(by)
    for c, said in by.items():
        said.sort(key=lambda x: (x[0], x[2], x[1], x[4], x[3]))
        r = parsed[c]
        assert r["turns"] == "".join(f"{role}\n{text}\n" for _, role, _, text, _ in said)
        assert r["loss"] == "".join(text for _, role, _, text, _ in said if role == "assistant")
        assert r["n_turns"] == len(said)
    assert all(s not in chat_format.escape("".join(bits)) for s in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<<ROLE>>"))
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="<p>no</p>";</script></head><body>
<header class="site">brand</header><nav><a href="/">home</a></nav><div class="cookie-notice">we use cookies, all of them, always</div>
<div id="main"><div class="post"><h1>Head &amp; line</h1><p>First   para,<br>with <b>bo</b>ld, commas, and &eacute;nough length to score well.<p>Second para, unclosed, and a <a href="x">link</a>.
<ul><li>item one<li>item two</ul><form><input><button>send</button></form><div class="ad">buy now, cheap, today</div><p>Tiny.</p></div>
<div class="comments"><p>Nice, very nice, I liked it, really, so much that I write on and on.</p></div></div>
<aside class="sidebar"><p>other, things, to, read, that go on for long and long and long</p></aside><footer>(c) me</footer></body></html>"""


def test_html(spark):
    want = "Head & line First para, with bold, commas, and énough length to score well. Second para, unclosed, and a link. item one item two Tiny."
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<html><body></body></html>", "x"), (5, "u", "plain, text", "x"), (6, "u", "<p>a<p>b" * 3000, "x"), (1, "u", PAGE, "x"), (7, "u", "<div><<p a='>'>ok &lt;b&gt; &#233;</p", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in html_extract.extract_pages(pages).collect():
        got[r["page_id"]].append((r["text"], r["n_chars"]))
    assert got[1] == [(want, len(want))] * 2
    assert got[2] == got[3] == got[4] == [("", 0)] and got[5][0][0] == "plain, text"
    assert got[6][0][0] == " ".join(["a", "b"] * 3000) and "ok <b> é" in got[7][0][0]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_html_keeps_what_stands_beside_the_best_container():
    long = "<p>" + "Words, and more words, that go on, and on, for a good while. " * 6 + "</p>"
    said = html_extract.extract("x" + long)[1:].strip()
    wrapped = f"<body><nav>menu</nav><article><h1>Head</h1><div class='body'>{long * 4}</div><h2>Next</h2><ul><li>item</li></ul><blockquote>Quote</blockquote><pre>code</pre></article></body>"
    assert html_extract.extract(wrapped) == " ".join(["Head", *[said] * 4, "Next item Quote code"])
    for box in ("article", "main", "div"):
        sections = f"<body><{box}><section>{long * 5}</section><section><h2>Short</h2><p>One line.</p></section><section><p>Last.</p></section></{box}></body>"
        assert html_extract.extract(sections) == " ".join([*[said] * 5, "Short One line. Last."])
    links = f"<body><div>{long * 4}</div><div><a href='x'>read this</a> <a href='y'>and that</a></div></body>"
    assert html_extract.extract(links) == " ".join([said] * 4)


def test_quality_rules(spark, docs, nothing):
    import re

    book = quality_rules.apply_policy(quality_rules.ledger(docs))
    assert book.count() == docs.count() and "label" in book.columns
    for r in book.select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "kept").collect():
        text = r["text"] or ""
        found = re.findall("[^\x20\x09-\x0d]+", text)
        grams = collections.Counter(tuple(found[k : k + 5]) for k in range(len(found) - 4))
        covered = {j for k in range(len(found) - 4) if grams[tuple(found[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert tuple(r)[1:6] == (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["failed"] == 0) == r["kept"]
    junk = [(1, " ".join(["again and again we say it"] * 9)), (2, "SHOUTING IS BAD FOR ALL OF US HERE AND NOW OK"), (3, "w### x%% y&& z$$ a## b## c## d## e## f## g##"), (4, "the quick brown fox jumps over the lazy dog near the old river bank")]
    bits = {r["doc_id"]: r["failed"] for r in quality_rules.ledger(spark.createDataFrame(junk, "doc_id long, text string")).collect()}
    assert bits[1] & quality_rules.BIT["repeated_words"] and bits[2] & quality_rules.BIT["shouting"] and bits[3] & quality_rules.BIT["symbols"] and not bits[4]
    told = {r["rule"]: (r["n_failed"], r["n_alone"]) for r in quality_rules.ablation(book).collect()}
    assert told["few_words"][0] >= told["few_words"][1] > 0
    assert quality_rules.ledger(nothing).count() == 0
    odd = docs.select("doc_id", "text", F.lit(1).alias("N_Words"), F.lit(2).alias("_q_x"), F.lit(3).alias("Rest"), F.lit(4).alias("a.b"))
    wide = quality_rules.apply_policy(quality_rules.ledger(odd))
    assert wide.columns == ["doc_id", "text", "_q_x", "Rest", "a.b", *quality_rules.MEASURES, "failed", "kept"]
    assert wide.where("failed != 0").count() == book.where("failed != 0").count()


def test_lexicon(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(300):
        said = words(rng, 30).split()
        toxic = k % 6 == 0
        if toxic:
            said[rng.randrange(30)] = "zzbad"
        rows.append((k, " ".join(said), "en"))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert "zzbad" in quality_rules.fit_lexicon(docs, marks)
    assert quality_rules.fit_lexicon(docs, marks.limit(0)) == []


def test_lexicon_finds_insults_of_many_forms(spark):
    """No form of the insult comes in 5 % of the toxic rows, and some clean rows hold one; per language."""
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(800):
        lang = ("en", "de")[k % 2]
        said, toxic = words(rng, 40).split(), k % 8 < 2
        for _ in range(3 if toxic else k % 10 == 3):
            said[rng.randrange(13) * 3] = {"en": "zzbad", "de": "xxböse"}[lang] + words(rng, 1)
        rows.append((k, " ".join(said), lang))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = quality_rules.fit_lexicon(docs, marks)
    failed = {r["doc_id"] for r in quality_rules.ledger(docs, lexicon).where("n_insults > 0").select("doc_id").collect()}
    for odd in (0, 1):
        toxic = {i for i, t in labels if t and i % 2 == odd}
        clean = {i for i, t in labels if not t and i % 2 == odd}
        assert len(failed & toxic) >= 0.8 * len(toxic) and len(failed & clean) <= 0.01 * len(clean)


def test_language_id(spark, sf_dir, nothing, docs):
    found = queries.op8_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out AND lang IS NOT NULL")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "und" and got[0]["score"] == 0 and got[6]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(nothing)).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0
    for n in (2, 3, 4, 5, 9):
        code = language_id.codewords(n)
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= (1 if n == 2 else 2)


def edits(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination(spark, docs, nothing):
    rng = random.Random(7)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) for _ in "ab")
        assert decontaminate.myers(p, t)[0] == edits(p, t)
    items = [(k, words(rng, 40)) for k in range(20)] + [(20, None), (21, "short"), (22, "")]
    rows, planted = [], set()
    for k in range(60):
        text = words(rng, 80)
        if k % 3 == 0:
            item = list(items[k % 20][1].upper().replace(" ", "\n ", 3))
            for _ in range(k % 4):
                item[rng.randrange(len(item))] = "#"
            text = text[:200] + " " + "".join(item) + " " + text[200:]
            planted.add((k, k % 20))
        rows.append((k, text, 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id int, text string")
    for size in (4_000_000, 1000):
        got = decontaminate.find_leaks(frame, bench, block_bytes=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == planted and all(r["distance"] <= r["budget"] for r in got)
    short = [(1, "A shorty, here"), (2, "shorts"), (3, "cannotshort short-handed"), (4, None), (5, ""), (6, words(rng, 30000) + " short")]
    found = decontaminate.find_leaks(spark.createDataFrame(short, "doc_id long, text string"), spark.createDataFrame([(1, "Short"), (2, " short "), (3, "")], bench.schema)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(3, 1), (3, 2), (6, 1), (6, 2)} and {r["start"] for r in found if r["doc_id"] == 3} == {12}
    p = "abcdefghij klmnopqrst uvwxyz0123 4567890abc"
    for change, start, end in ((p, 4, 4 + len(p)), (p[:20] + p[21:], 4, 3 + len(p)), (p[:20] + "#" + p[20:], 4, 5 + len(p))):
        hit = decontaminate.Matcher([(1, p)], 0.06, 8, 24).find("xyz " + change + " tail of the text")
        assert [(h[2], h[3]) for h in hit] == [(start, end)]
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.count() == 40 and set(kept.columns) == set(frame.columns)
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(nothing, bench).count() == 0


def test_url_filters(spark, sf_dir):
    from datetime import datetime as D

    rows = [
        (1, "http://A.b.Evil.com:80/x/?q#f", D(2024, 1, 5)), (2, "https://u:p@evil.com./", D(2024, 1, 1)), (3, "http://evil.com", D(2024, 2, 1)), (4, None, D(2024, 1, 5)),
        (5, "nonsense", D(2024, 1, 5)), (6, "http://notevil.com/", D(2024, 1, 5)), (7, "http://ok.com/Bad/", D(2024, 1, 5)), (8, "http://evil.com/", None), (1, "http://A.b.Evil.com:80/x/?q#f", D(2024, 1, 5)),
    ]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetch_ts timestamp_ntz").withColumn("pattern", F.lit("x"))
    listed = [
        ("domain", "evil.com", "malware", "add", D(2024, 1, 2)), ("domain", "evil.com", "malware", "remove", D(2024, 1, 20)), ("domain", "b.evil.com", "adult", "add", D(2024, 1, 1)),
        ("url", "ok.com/bad", "phishing", "add", D(2024, 1, 5)), ("domain", None, "x", "add", D(2024, 1, 1)), ("domain", "evil.com", "malware", "add", D(2024, 1, 2)),
    ]
    entries = spark.createDataFrame(listed, "kind string, pattern string, list_name string, action string, at timestamp_ntz")
    got = {r["page_id"]: (r["blocked"], r["n_entries"], r["list_name"]) for r in url_filters.filter_captures(captures, entries).collect()}
    assert got == {1: (True, 2, "adult"), 2: (False, 0, None), 3: (False, 0, None), 4: (False, 0, None), 5: (False, 0, None), 6: (False, 0, None), 7: (True, 1, "phishing"), 8: (False, 0, None)}
    assert url_filters.filter_captures(captures.limit(0), entries).count() == 0
    assert url_filters.filter_captures(captures, entries.limit(0)).where("blocked").count() == 0
