"""Token counts, language, quality, personal data and page text, with odd rows."""

import hashlib
import re

import public_tokenizers
import pytest
from tables import DIR
from pyspark.sql import functions as F
from tidebook.llm import html_text, language_id, pii, quality, token_counts

ODD = [(1, None), (2, ""), (3, "a  b \n c<|endoftext|>d"), (3, "a  b \n c<|endoftext|>d"), (4, "x" * 20000), (None, "é 😀 it's 12.5%"), (5, " lead")]


def test_token_counts_and_cache(frame, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = frame([(*r, "x") for r in ODD], "doc_id long, text string, n_tokens string")
    for _ in range(2):  # the second run finds all counts stored
        rows = token_counts.token_counts(docs, path, str(tmp_path), limit=3).collect()
        for r in rows:
            text = next(t for i, t in ODD if i == r.doc_id) or ""
            n = len(library.encode(text, add_special_tokens=False))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 3)
        assert len(rows) == len(ODD)
    stored = docs.sparkSession.read.parquet(str(tmp_path))
    assert stored.count() == len({t or "" for _, t in ODD})
    assert token_counts.token_counts(docs.limit(0), path, str(tmp_path)).count() == 0


def test_tables_agree_with_library(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert found == {r.doc_id: len(library.encode(r.text, add_special_tokens=False)) for r in docs.collect()}


def test_automaton_counts_longest_matches(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    reference, text = rng.integers(0, 3, 60).astype(np.int32), rng.integers(0, 4, 200).astype(np.int32)
    joined, phrases, at = "".join(map(str, reference)), 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and "".join(map(str, text[at : at + n + 1])) in joined:
            n += 1
        phrases, at = phrases + 1, at + n
    automaton = language_id.SuffixAutomaton(reference, 4)
    assert automaton.phrases(text[None, :], np.array([200]))[0] == phrases


def test_languages(frame):
    docs = frame([(i, "the thing was with them and that", "en") for i in range(20)] + [(100 + i, "der und die nicht schön für", "de") for i in range(20)] + [(900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    samples = language_id.learn(docs)
    assert set(samples) == {"en", "de"}
    crowd = frame([(i, "la casa", "es") for i in [7] * 500 + [None] * 500] + [(8, "el perro", "es")], "doc_id long, text string, lang string")
    assert sorted(language_id.learn(crowd)["es"].split(" ")) == ["casa", "el", "la", "perro"]
    asked = frame([(1, "with the thing"), (2, "nicht für die"), (3, None), (4, "123 !"), (4, "123 !"), (5, "the thing " * 3000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.identify(asked, samples).collect()}
    assert [rows[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert language_id.identify(asked, {}).where("lang_pred != 'und'").count() == 0
    assert language_id.identify(asked.limit(0), samples).count() == 0


def test_quality(spark, frame):
    docs = spark.read.parquet(f"{DIR.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DIR.replace('0.001', '0.01')}/labels.parquet")
    held = language_id.held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs, labels.where(~held))
    rows = quality.scored(docs, model).join(labels.where(held), "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
    odd = quality.scored(frame([(*r, 9) for r in ODD], "doc_id long, text string, score int"), model)
    assert odd.columns == ["doc_id", "text", "score"] and odd.where("score between 0 and 1").count() == len(ODD)
    assert quality.fit(docs, labels.limit(0)) == quality.ACCEPT_ALL
    assert quality.keep_accepted(docs.limit(0), model).count() == 0
    crowd = frame([(1, "Good words stand here.")] * 300 + [(2, "bad bad bad"), (3, "Another good line."), (4, "$$ bad"), (None, "x")], "doc_id long, text string")
    asked = frame([(1, 1)] * 300 + [(2, 0), (3, 1), (4, 0), (None, 0), (3, None)], "doc_id long, quality int")
    assert quality.fit(crowd, asked) == quality.fit(crowd.distinct(), asked.distinct())


def test_quality_learns_from_all_labels(spark, frame, monkeypatch):
    """Of 4,500 rows of each label as many lie below the threshold as have label 0, wherever the texts are joined."""
    words = lambda i, n: " ".join(f"w{i * 31 % (7 + j)}{'x' * (i * 7 % (j + 2))}" for j in range(n))
    docs = frame([(i, words(i, 5 + i * 13 % 40) + ("." * (i % 3) if i % 2 else "#" * (i % 5))) for i in range(9000)], "doc_id long, text string").cache()
    labels = frame([(i, i % 2) for i in range(9000)], "doc_id long, quality int").cache()
    model = quality.fit(docs, labels)
    strengths = sorted(r.score for r in quality.scored(docs, model).collect())
    at = [s for s in strengths if abs(s - 0.5) < 1e-12]
    below = sum(s < 0.5 - 1e-12 for s in strengths)
    assert at and below <= 4500 < below + len(at)
    monkeypatch.setattr(quality, "SENT_LABELS", 10)
    again = quality.fit(docs, labels)
    assert again.threshold == pytest.approx(model.threshold, rel=1e-4) and again.weights == pytest.approx(model.weights, rel=1e-4)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, match):
    digits = [int(x) for x in match if x.isdigit()]
    back = digits[::-1]
    luhn = (sum(back[::2]) + sum(sum(divmod(2 * x, 10)) for x in back[1::2])) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in match.split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]


def test_personal_data(spark, frame):
    texts = ["a@b.c_d@e.f x 1.2.3.4.5.6.7.8 +1 (171) 555-2028-. 4111 1111 1111 1111 256.1.1.1 é😀 a@b.co", None, "", "9" * 30000 + " " + "a" * 200000 + " 1 2 3" * 3000, "+1234567890+12345678901 00001.02.003.255 3-"]
    texts += [f"seen address 1{i}.{i % 7}.2.{i % 10} today" for i in range(10, 40)] + ["seen address 999.1.2.3 today"]
    docs = frame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y")], "doc_id long, text string, spans string")
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        spans = sorted((m.start(), k, m.end()) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], texts[r.doc_id] or "") if valid(kind, m[0]))
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == ("ip:13:22" if r.doc_id == len(texts) - 1 else base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_pages(frame):
    page = "<html><head><title>t</title></head><body><div class='x'>Site {h}</div><nav>menu</nav><article><h1>T&eacute;st {i}</h1><p>One  <b>two</b><br>three<p>copied</article><div>Read on</div><footer>f</footer>"
    rows = [(i, "http://h.org/a", page.format(h="h", i=i), 1) for i in range(20)] + [(0, "http://h.org/a", page.format(h="h", i=0), 1)]
    rows += [(100, None, None, 1), (101, "http://h.org/b", "", 1), (None, "x", "plain &amp; text", 1)]
    bare = "<body><div>Recurring head</div><div id=content><p>Own text of page {i}, which is the longest part</p></div><div>Recurring foot</div></body>"
    rows += [(200 + i, "https://bare.org/", bare.format(i=i), 1) for i in range(20)]
    rows += [(300, "http://few.org/", "<div id='cookie-notice'>We use</div><p>Kept</p><section class='comments'><p>hi</p></section><form>q</form><!-- c --><script>if(a<b){'</p>'}</script>", 1)]
    found = html_text.extract(frame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(found) == len(rows)
    texts = {r.page_id: r.text for r in found}
    assert texts[3] == "Tést 3\nOne two three\ncopied" and texts[100] == texts[101] == "" and texts[None] == "plain & text"
    assert texts[205] == "Own text of page 5, which is the longest part" and texts[300] == "Kept"
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_text.extract(frame([], "page_id long, url string, html string")).count() == 0


def test_unusable_rows_do_not_thin_a_language(spark, frame):
    real = frame([(i, f"satu dua tiga {'abcdefghij'[i % 10] * 3}", "id") for i in range(300)], "doc_id long, text string, lang string")
    many = spark.range(400_000).selectExpr("if(id % 2 = 0, 1000, id + 5000) as doc_id", "if(id % 2 = 0, 'empat lima', if(id % 4 = 1, null, '12 3')) as text", "'id' as lang")
    one = frame([(1000, "empat lima", "id")], "doc_id long, text string, lang string")
    assert language_id.learn(real.union(many)) == language_id.learn(real.union(one))


def test_section_template_goes_on_a_large_host(frame):
    own = "<article><h1>T {i}</h1><p>Own text of page {i}, longer than what stands beside it</p>{menu}</article>"
    rows = [(i, "http://big.org/a", own.format(i=i, menu="<div>Read in this section</div>" if i < 30 else f"<div>{i} seen</div>")) for i in range(3000)]
    texts = {r.page_id: r.text for r in html_text.extract(frame(rows, "page_id long, url string, html string")).collect()}
    assert not any("section" in x for x in texts.values()) and all(f"{i} seen" in texts[i] for i in range(30, 3000))


def test_texts_without_letters_have_no_language(frame):
    samples = language_id.learn(frame([(i, "the thing was with them", "en") for i in range(20)] + [(100 + i, "der und die schön", "de") for i in range(20)], "doc_id long, text string, lang string"))
    docs = frame([(1, "😀😀", 5), (2, "123 ... 😀", 5), (3, "𐐨𐐩 the thing was", 5), (4, "𐐨", 5)], "doc_id long, text string, lang_pred int")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, samples).collect()}
    assert found[1] == found[2] == ("und", 0.0)
    assert found[3][0] == "en" and found[4][0] in ("de", "en")


def test_repeated_rows_add_no_evidence(frame):
    seeds = [(i, f"call +1 555 010 {1000 + i:04d}x mail a{i}@b.org now") for i in range(10)]
    unseen = [(100 + i, f"mail ü{i}@b.org now") for i in range(60)]
    once = {(r.doc_id, r.spans) for r in pii.find_personal_data(frame(seeds + unseen, "doc_id long, text string")).collect()}
    again = {(r.doc_id, r.spans) for r in pii.find_personal_data(frame(seeds + unseen + unseen[:1] * 6 + seeds[:3] * 4, "doc_id long, text string")).collect()}
    assert once == again


def test_titles_teasers_and_class_words(frame):
    pages = {
        1: ("<article><header><div><h1>Title</h1></div></header><p>Body text</p></article>", "Title\nBody text"),
        2: ("<article><h1>A</h1><p class='social-science'>Kept</p><div class='share-bar'>x</div><div id=comments><p>c</p></div><p class=ad>y</p></article><article class='card'><p>Teaser</p></article>", "A\nKept"),
        3: ("<div class='with-sidebar'><div class='sidebar layout'><article><p>Text &amp; more</p></article></div><div class=sidebar>menu</div></div>", "Text & more"),
        4: ("<article><p>First of a list</p></article><article><p>Second of a list</p></article>", "First of a list\nSecond of a list"),
        5: ("<article><p>The only long text of this page</p><p>and its second part</p></article><article><p>See also</p></article>", "The only long text of this page\nand its second part"),
        6: ("<div>" * 20000 + "deep", "deep"),
        7: ("<b>" * 20000 + "<p>a</x></p>" * 2000, "\n".join("a" * 2000)),
        8: ("<ul>" + "<b>" * 20000 + "<li>a" * 2000, "\n".join("a" * 2000)),
        9: ("<table><tr><td>a<td>b<tr><th>c</table><dl><dt>d<dd>e</dl><p>f<p>g<div>h</div></p>i", "\n".join("abcdefghi")),
        10: ("no markup &lt;b&gt; " + "word " * 50000, "no markup <b> " + " ".join(["word"] * 50000)),
    }
    rows = [(i, None, html) for i, (html, _) in pages.items()]
    found = {r.page_id: r.text for r in html_text.extract(frame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: text for i, (_, text) in pages.items()}


def test_template_counts_agree_with_plain_python(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url", "html")
    side = "<article><h1>T {0}</h1><p>Own {0}</p><div>Read in section {1}</div></article><div>seen {2}</div>"
    more = [(10**9 + i, f"http://made{i % 3}.org/", side.format(i, i % 5, i % 9)) for i in range(90)]
    pages = pages.union(spark.createDataFrame(more, "page_id long, url string, html string"))
    rows = pages.select("page_id", html_text.host_of(F.col("url")).alias("host"), "html").collect()
    counts, parsed = {}, {}
    for r in rows:
        order, roots = html_text.prepare(r.html or "")
        parsed[r.page_id] = r.host, order, roots
        for x in html_text.candidates(order, roots):
            counts.setdefault((r.host, x.digest), set()).add(tuple(y.digest for y in roots))
    template = {key for key, contents in counts.items() if len(contents) >= 3}
    expected = {i: html_text.main_text(order, roots, {d for h, d in template if h == host}) for i, (host, order, roots) in parsed.items()}
    assert {r.page_id: r.text for r in html_text.extract(pages, min_pages=3).collect()} == expected and len(template) > 0


def test_contexts_find_what_no_format_covers(frame):
    seeds = [(i, f"Please call +1 555 010 {1000 + i:04d} today or mail a{i}@b.org now") for i in range(40)]
    long = "w" * 100
    asked = {
        100: ("Please call 017-555-7713 today", "phone", "017-555-7713"),
        101: ("Please call 017 555 77 13 today", "phone", "017 555 77 13"),
        102: ("or mail jo@host now", "email", "jo@host"),
        103: (f"or mail {long}@host now", "email", f"{long}@host"),
        104: ("we call 12 times", None, None),
        105: ("the code 017-555-7713 here", None, None),
        106: (" ".join(["1"] * 3000) + "x", None, None),
    }
    docs = frame(seeds + [(i, text) for i, (text, _, _) in asked.items()], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    for i, (text, kind, token) in asked.items():
        assert found[i] == ("" if kind is None else f"{kind}:{text.index(token)}:{text.index(token) + len(token)}")
