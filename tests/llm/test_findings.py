"""Cases of the first round's findings."""

import random


def license_labels(words):
    """Brute force: all templates at or above 0.8, but for variants that a fuller one explains."""
    from matchgrid.llm.license_scan import FOLD, TEMPLATES

    sets = [(label, set(t.encode().translate(FOLD).split())) for label, t in TEMPLATES]
    held = [(label, t & set(words), len(t & set(words)) / len(t)) for label, t in sets]
    held = [h for h in held if h[2] >= 0.8]
    return sorted((a, s) for a, x, s in held if not any(r > s and x <= y for _, y, r in held))


def test_license_blocks_give_every_template():
    from matchgrid.llm.license_scan import FOLD, TEMPLATES, VOCABULARY, Join

    join, rng = Join({}), random.Random(8)
    own = {label: text.encode().translate(FOLD).split() for label, text in TEMPLATES}
    bsd = [b"changed" if w == b"source" else w for w in own["bsd"]]
    assert {label for label, _ in join.matches(own["reserved"] + bsd)} == {"reserved", "bsd"}
    assert [label for label, _ in join.matches(own["cc-by-sa"])] == ["cc-by-sa"]
    vocab, several = sorted(VOCABULARY), 0
    for _ in range(2000):
        words = rng.sample(vocab, rng.randint(1, 20))
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(TEMPLATES)[1].encode().translate(FOLD).split()
            words += rng.sample(t, max(1, len(t) - rng.randint(0, 3)))
        want = license_labels(words)
        assert sorted(join.matches(words)) == want
        several += len({s for _, s in want}) > 1
    assert several > 200


def test_license_notices_across_lines(spark):
    from matchgrid.llm.license_scan import TEMPLATES, license_scan

    rows, want = [], {}
    for n, (label, text) in enumerate(TEMPLATES):
        words = text.split()
        for k, mark in enumerate(("# ", " * ", "// ")):
            step = max(2, min(len(words) // 2, 4 + k))
            lines = [mark + " ".join(words[i : i + step]) for i in range(0, len(words), step)]
            rows.append((3 * n + k, "some code before\n" + "\n".join(lines) + "\nand code behind"))
            want[3 * n + k] = label
    rows.append((900, "licensed under cc\nby sa 4.0"))
    rows.append((901, "this work is licensed under the\ngnu general public license version 3"))
    rows.append((902, "all rights\n" + "other words " * 5 + "\nreserved"))
    rows.append((903, "license the\nunder other\nreleased mit\n" * 3000))
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, label in want.items():
        assert label in got[d].labels.split(",") and got[d].score == 1.0, d
    assert got[900].labels == "cc-by,cc-by-sa"  # the first is a base phrase
    assert got[901].labels == "gpl,gpl-3.0"
    assert got[902].labels == ""
    assert got[903].labels == "mit"


def test_html_names_are_only_a_penalty():
    from matchgrid.llm.html_extraction import main_text

    body = "A paragraph of some length, with commas, and words enough to count as text. " * 3
    text, side = " ".join(body.split()), "Some other text beside the article, not part of it."
    inner = f"<h1>Head</h1><p>{body}<p>{body}"
    want = f"Head\n\n{text}\n\n{text}"
    wrappers = (
        "class='content has-sidebar'", "id='page-with-nav'", "class='post no-comments'", "class=content-sidebar-wrap",
        "class='layout sidebar-left'", "class=widget", "id=nav-page class='with-social main'",
    )
    for w in wrappers:
        page = f"<nav>Menu</nav><div {w}><div class=inner>{inner}</div><div class=sidebar><p>{side}</div></div><footer>F</footer>"
        assert main_text(page) == want, w
        assert main_text(f"<div class=ad>{side}</div><div {w}>{inner}</div>") == want, w
        assert main_text(f"<div {w}><div class=cookie-notice><p>{side}</div><article>{inner}</article></div>") == want, w
    assert main_text(f"<div id=main><div class='entry-header'><h1>Head</h1></div><p>{body}<p>{body}</div>") == want
    # Long furniture still loses to the text, and a short text to no advert.
    many = f"<p>{body}" * 5
    assert main_text(f"<div id=main>{inner}</div><div class=comments>{many}</div>") == want
    assert main_text(f"<div id=main>{inner}<div class='post-comments'>{many}</div></div>") == want
    assert main_text(f"<div class=ad>{side}</div><article><h1>Short</h1></article>") == "Short"


def test_pipeline_removes_short_repeated_lines(spark):
    from matchgrid.llm import line_dedup

    near = "a line that is long enough to take part, number {}"
    rows = [
        (1, "Les.\nAnd ornd.\n\n\t\nfirst text of some length\n Les. "),
        (2, "Les.\nLes!\n\n\t\nAnd ornd.\nsecond, quite another text"),
        (3, "Les.\nAnd ornd."),
        (4, near.format(1) + "\r\n\r\n\r\nx"),
        (5, near.format(2) + "\r\n\r\n\r\nx"),
    ] + [(n, f"Les.\nown text of the document {n * 7919}") for n in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got[1] == "Les.\nAnd ornd.\n\n\t\nfirst text of some length"
    assert got[2] == "Les!\n\n\t\nsecond, quite another text"  # an edit counts in long lines only
    assert 3 not in got
    assert got[4] == rows[3][1] and 5 not in got
    assert all(got[n] == f"own text of the document {n * 7919}" for n in range(20, 60))
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}[3] == ""


def test_pipeline_removes_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    common = " ".join(word() for _ in range(30))
    texts = []
    for n in range(40):
        base = [word() for _ in range(rng.randint(40, 150))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own) + (" " + common if n % 2 else ""))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, ""), (901, None), (902, "two words")], "doc_id long, text string")

    def sets(rows):
        out = {}
        for d, x in rows:
            w = (x or "").lower().split()
            out[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        return out

    def near(s):
        ids = sorted(s)
        return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]

    from matchgrid.llm import simhash

    stage = dict(corpus_pipeline.STAGES)["simhash"]
    before = [(r.doc_id, r.text) for r in simhash.one_per_component(docs).collect()]
    links = near(sets(before))
    assert len(links) > 50
    up = {d: d for d, _ in before}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in stage(spark, docs, "none").collect()) == sorted({root(d) for d, _ in before})


def test_encoder_reads_like_the_tokenizer():
    import numpy as np
    import tokenizers

    from matchgrid.llm.packing import Encoder
    from matchgrid.llm.queries import tokenizer_path

    whole, encode, rng = tokenizers.Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path()), random.Random(11)
    letters = [chr(c) for c in range(0x20, 0x250)]
    texts = ["area of 20 m² and", "x² + y²", "H²O", "footnote¹ here", "½ cup", "²", "<|endoftext|>", "a b", "ﬁ ①"]
    for _ in range(30_000):
        n = rng.randint(1, 30)
        texts.append("".join(rng.choice(letters) if rng.random() < 0.3 else rng.choice("abc de'fg 12.,") for _ in range(n)))
    for text, got in zip(texts, encode(texts), strict=True):
        assert got == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_emptiest_bins_of_all_blocks_meet(spark):
    from pyspark.sql import functions as F

    from matchgrid.llm import packing
    from matchgrid.llm.queries import tokenizer_path

    rng = random.Random(12)
    docs = spark.createDataFrame([(n, "word " * rng.randint(1, 8)) for n in range(600)], "doc_id long, text string")
    got = packing.pack(docs, tokenizer_path(), limit=40, block_pieces=40)
    bins = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    rows = bins.collect()
    assert all(r.n == r.end <= 40 for r in rows) and got.count() == 600
    assert len(rows) <= -(-sum(r.n for r in rows) // 40) + 3


def test_suffix_runs_of_long_texts():
    import numpy as np

    from matchgrid.llm.suffix_dedup import GRAM, WINDOW, next_digit, runs

    rng = random.Random(13)
    raw = bytes(rng.choice(b"abcd ") for _ in range(5000))
    covered = []
    for chunk in (64, 1000, 1 << 24):  # texts longer than a chunk are read in turns
        k, at, low, high = runs(raw, chunk)
        starts = np.concatenate([np.arange(p - h, p - w + 1) for p, w, h in zip(at, low, high, strict=True)])
        assert starts.tolist() == list(range(len(raw) - WINDOW + 1))
        covered.append({s: p for p, w, h in zip(at, low, high, strict=True) for s in range(p - h, p - w + 1)})
    assert covered[0] == covered[1] == covered[2]
    # The digits of a window are all of its bytes, each once.
    top, h = 168, 57
    wide, mid = h // 25 * 25, h // 5 * 5
    digits = [next_digit(raw, top, wide, 25, None), next_digit(raw, top, mid, 5, (wide, 25)), next_digit(raw, top, h, 1, (mid, 5))]
    assert GRAM + sum(map(len, digits)) == WINDOW
    assert sorted(b"".join(digits) + raw[top : top + GRAM]) == sorted(raw[top - h : top - h + WINDOW])


def test_crf_labels_lines_not_documents(spark):
    """Fitted on documents of four folds, judged on the fifth; boilerplate around content is told apart."""
    import zlib

    from matchgrid.llm import quality_rules as Q
    from matchgrid.session import table

    base = "/root/testdata/sf0.01"
    docs, labels = table(spark, base, "documents"), table(spark, base, "labels")
    rows = [(r.doc_id, r.text, r.quality) for r in docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()]
    held = [(x, q) for d, x, q in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    learn = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    weights, trans = Q.fit_crf(Q.training_sequences(docs, learn))
    share = [(Q.assess(x, weights, trans)[-1], q) for x, q in held]
    good, poor = [s for s, q in share if q], [s for s, q in share if not q]
    assert sum(s >= 0.5 for s in good) >= 0.95 * len(good)
    assert sum(s < 0.5 for s in poor) >= 0.8 * len(poor) and len(poor) >= 10
    # Staying is not the only thing that the chain has learned.
    assert trans[0, 0] - trans[0, 1] < 3 and trans[1, 1] - trans[1, 0] < 3
    plain = [x.split("\n")[0] for x, q in held if q and 200 < len(x.split("\n")[0]) < 900][:8]
    junk = [line for x, q in held if not q for line in x.split("\n") if len(line) > 100 and any(c in line for c in "|$!")][:8]
    for a, b in zip(plain, junk, strict=False):
        lines = [b, a, a + " and more", b]
        path = Q.viterbi(weights[Q.np.array(Q.line_features([x.encode() for x in lines]))].sum(1), trans)
        assert path == [Q.BOILERPLATE, Q.CONTENT, Q.CONTENT, Q.BOILERPLATE]


def test_line_labels_keep_the_side_of_their_document():
    import numpy as np

    from matchgrid.llm import quality_rules as Q

    weights = np.zeros((Q.N_FEATURES, 2))
    weights[0], weights[1] = (2, 0), (0, 2)  # feature 0 speaks for boilerplate
    lines = [(0,), (1,), (1,), (0,)]
    none = np.zeros((2, 2))
    assert Q.line_labels((lines, [5, 1, 1, 5], Q.BOILERPLATE), weights, none).tolist() == [0, 1, 1, 0]
    assert Q.line_labels((lines, [1, 5, 5, 1], Q.BOILERPLATE), weights, none).tolist() == [0, 0, 1, 0]
    assert Q.line_labels((lines, [1, 5, 5, 1], Q.CONTENT), weights, none).tolist() == [0, 1, 1, 0]


def test_html_keeps_all_of_the_article():
    from matchgrid.llm.html_extraction import main_text

    body = "A paragraph of some length, with commas, and words enough to count as text. " * 3
    text = " ".join(body.split())
    short = "One short sentence ends the page."
    menu = "<ul><li><a href=/>Home</a><li><a href=/a>About</a></ul>"
    long = f"<section><p>{body}<p>{body}</section>"
    pages = {
        f"<div id=page>{long}<section><p>{short}</section></div>": f"{text}\n\n{text}\n\n{short}",
        f"<div id=page><div>{long}</div><table><tr><td>a<td>1<tr><td>b<td>2</table></div>": f"{text}\n\n{text}\n\na\n\n1\n\nb\n\n2",
        f"<div><div><div>{long}</div></div><ul><li>one<li>two</ul></div>{menu}": f"{text}\n\n{text}\n\none\n\ntwo",
        f"<div>{menu}<h2>Head</h2>{long}<h3>Notes</h3><p>Short.</div>": f"Head\n\n{text}\n\n{text}\n\nNotes\n\nShort.",
        f"<div>{long} Loose text beside it, a whole sentence. <b>Bold</b><div>&copy; 2024</div></div>": f"{text}\n\n{text}\n\nLoose text beside it, a whole sentence. Bold",
        f"<article><p title=it's>{body}<p title='a>b'>{body}<p data-id=nav class=\"x\">{short}</article>": f"{text}\n\n{text}\n\n{short}",
        f"<nav>{menu}</nav><div class=ad>{body}</div><article><h1>Head</h1>{long}</article><div><a href=/>Next page of this site</a></div>": f"Head\n\n{text}\n\n{text}",
        "<div class='content no-sidebar'><p>" + body + "</div>": text,
        f"<div class='post nav-enabled'><p>{body}</div><footer>F</footer>": text,
        f"<div class='form-factor'><p>{body}<p>{body}</div>": f"{text}\n\n{text}",
        f"<div class='article-header'><h1>Head</h1></div><p>{body}<p>{body}": f"Head\n\n{text}\n\n{text}",
    }
    for page, want in pages.items():
        assert main_text(page) == want, page
        assert main_text(f"<html><body>{page}<footer>Foot</footer></body></html>") == want, page


def test_html_of_generated_pages(spark):
    """All pages of the smallest tables: the article's blocks, read off the source by pattern."""
    import re
    from html import unescape

    from matchgrid.llm.html_extraction import main_text
    from matchgrid.session import table

    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|<footer|\Z)", r.html).group(1)
        parts = re.split(r"</?(?:p|h1|article|div|ul|li|h2)\b[^>]*>", inner)
        want = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in parts]
        assert main_text(r.html) == "\n\n".join(w for w in want if w), r.page_id


def test_decontamination_query_and_blocks(spark, sf):
    """The query's rows against a search of every item, and the same by several blocks."""
    from matchgrid.llm import decontamination as D
    from matchgrid.llm import queries
    from matchgrid.session import table

    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    rows, items = docs.select("doc_id", "text").collect(), bench.collect()
    got = {(r.doc_id, r.item_id): r for r in queries.op7_decontamination(spark, sf).collect()}
    for r in rows:
        text = D.normalize(r.text)
        for i in items:
            item = D.normalize(i.text)
            at, found = text.find(item), got.pop((r.doc_id, i.item_id), None)
            if at >= 0:
                assert (found.edits, found.start, found.length) == (0, at, len(item))
            elif found is not None:  # near occurrences: the region is within the budget
                assert 0 < found.edits <= D.budget(len(item))
    assert not got
    want = sorted(map(tuple, D.decontamination(docs, bench).collect()))
    size = sum(len(i.text) for i in items) // 3
    assert sorted(map(tuple, D.decontamination(docs, bench, size).collect())) == want and want
    one = sorted(r.doc_id for r in D.drop_contaminated(docs, bench).collect())
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, bench, size).collect()) == one
    assert one == sorted({r.doc_id for r in rows} - {w[0] for w in want})


def test_license_query_labels_and_scores(spark):
    """The query's labels and scores on whole tables against all templates on all lines and windows."""
    from math import ceil

    from matchgrid.llm import queries
    from matchgrid.llm.license_scan import FOLD, TEMPLATES
    from matchgrid.session import table

    base = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op3_license_scan(spark, base).collect()}
    sets = [(label, set(t.encode().translate(FOLD).split()), ceil(len(t.encode().translate(FOLD).split()) / 0.8)) for label, t in TEMPLATES]
    named = several = 0
    for r in table(spark, base, "documents").select("doc_id", "text").collect():
        folded = (r.text or "").encode().translate(FOLD)
        lines = [line.split() for line in folded.split(b"\n")]
        found = [m for line in lines for m in license_labels(line)]
        words, mine = folded.split(), got[r.doc_id]
        base_labels = set(mine.base_labels.split(",")) - {""}
        want = {label for label, _ in found} | base_labels
        labels = set(mine.labels.split(",")) - {""}
        assert labels >= want
        # What is found besides lies in a window across lines.
        for label in labels - want:
            several += 1
            assert any(len(t & set(words[i : i + n])) >= 0.8 * len(t) for x, t, n in sets if x == label for i in range(len(words)))
        if labels == want:
            assert mine.score == max([s for _, s in found] + [1.0] * bool(base_labels), default=0.0)
            named += bool(labels)
    assert named > 5


def test_lines_one_word_apart(spark):
    from matchgrid.llm import line_dedup

    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    lines = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([8, 10, 11, 40]))]
        for _ in range(rng.choice([1, 3, 6])):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                j, op = rng.randrange(len(own)), rng.randrange(3)
                own[j : j + (op != 1)] = [] if op == 0 else [word()]
            lines.append(" ".join(own))
    rng.shuffle(lines)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    up = list(range(len(lines)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    links = 0
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            words = min(len(a.split()), len(b.split())) >= 10 and distance(a.split(), b.split()) <= 1
            if a == b or words or (min(len(a), len(b)) >= 16 and distance(a, b) <= 1):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
                links += 1
    assert links > 20
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert got == {n: line if root(n) == n else "" for n, line in enumerate(lines)}


def test_html_names_never_drop_the_subject():
    """Headings, ids and sections named after their subject stay; boxes named as furniture go."""
    from matchgrid.llm.html_extraction import main_text

    text = "A paragraph of the article that is long enough, with commas, to count as one."
    stay = [
        ('<h2 id="discussion">Discussion</h2>', ["Discussion"]),
        ('<h3 id="search-methods">Search methods</h3>', ["Search methods"]),
        ('<h2 id="search"><a href="#search">Search</a></h2>', ["Search"]),
        (f'<section id="discussion"><p>{text}</p></section>', [text]),
        (f'<section id="related-work"><h2>Related work</h2><p>{text}</p></section>', ["Related work", text]),
        (f'<section class="social-impact"><p>{text}</p></section>', [text]),
        (f'<div id="discussion"><p>{text}</p></div>', [text]),
        ('<p class="form">The form of it.</p>', ["The form of it."]),
        ('<p id="search">We searched.</p>', ["We searched."]),
        ("<h2>Sources</h2><ul><li><a href=x>First source</a><li><a href=y>Second source</a></ul>", ["Sources", "First source", "Second source"]),
        ("<div>By A. Writer</div>", ["By A. Writer"]),
    ]
    go = ['<div class="ad">Buy</div>', '<p class="advert">Buy it now</p>', '<section class="comments"><p>Reader: what a fine article, thank you, all.</p></section>',
          '<section id="comments"><p>Reader: what a fine article, thank you, all.</p></section>', '<div class="share-box">Share this</div>'.replace("share-box", "share"),
          '<ul class="social"><li>Post</ul>', '<div class="related-posts"><a href=x>Another article</a></div>', '<div id="newsletter-box">Your address</div>', '<li class="comment">Nice</li>']
    for open_, close in (("<article>", "</article>"), ("<div class=page><div class=content>", "</div></div>"), ("<main>", "</main>")):
        for html, want in stay:
            page = f"<html><body><nav><a href=/>Home</a></nav>{open_}<p>{text}</p>{html}<p>{text}</p>{close}<footer>Foot</footer></body></html>"
            assert main_text(page) == "\n\n".join([text, *want, text]), (open_, html)
        for html in go:
            page = f"<html><body><nav><a href=/>Home</a></nav>{open_}<p>{text}</p>{html}<p>{text}</p>{close}<footer>Foot</footer></body></html>"
            assert main_text(page) == "\n\n".join([text, text]), (open_, html)


def test_html_keeps_what_stands_beside_the_best_container():
    """The best container lies below the wrapper: its short and linked siblings stay, a menu goes."""
    from matchgrid.llm.html_extraction import main_text

    long = "A paragraph of the article that is long enough, with commas, many, to count as one."
    page = (
        "<html><body><div id=wrap><div><a href=/>Home</a> <a href=/news>News</a></div><div>Short note</div>"
        f"<div><p>{long}</p><p>{long}</p><p>{long}</p></div><h3>Sources</h3><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div></body></html>"
    )
    assert main_text(page) == "\n\n".join(["Short note", long, long, long, "Sources", "One", "Two"])


def test_components_with_a_hub(spark, monkeypatch):
    """A hub of many leaves beside chains and a second hub in the middle, with its links spread and not."""
    from matchgrid.llm import common
    from matchgrid.llm.components import connected_components
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    leaves = spark.range(20_000).select((F.lit(100_000) + F.col("id")).alias("u"), F.lit(50_000).cast("long").alias("v"))
    more = spark.range(3_000).select(F.lit(7).cast("long").alias("u"), (F.col("id") + 1_000).alias("v"))
    chain = spark.range(60).select((F.col("id") + 200_000).alias("u"), (F.col("id") + 200_001).alias("v"))
    links = leaves.unionByName(more).unionByName(chain)
    for one_task in (0, 1_000_000):
        got = {r.root: r.n for r in connected_components(links, one_task).groupBy("root").agg(F.count("*").alias("n")).collect()}
        assert got == {50_000: 20_001, 7: 3_001, 200_000: 61}


def test_near_copies_without_ids(spark):
    """Rows without an id take part; of a group the smallest id stays, of rows without one any."""
    from matchgrid.llm.simhash import one_per_component, without_near_copies

    words = " ".join(f"word{i}" for i in range(60))
    near = words.replace("word30", "other")
    rows = [(3, near, "x"), (None, words, "x"), (None, words, "y"), (8, "something else of quite other words", "x"), (8, "something else of quite other words", "x"), (None, None, "x"), (5, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    assert sorted((r.doc_id or 0, r.text or "") for r in without_near_copies(docs).collect()) == [(3, near), (5, ""), (8, rows[3][1])]
    assert one_per_component(docs).columns == docs.columns


def test_toxicity_with_one_class_only(spark):
    """Rows of one class tell nothing apart: every score is next to 0, and none is flagged."""
    from matchgrid.llm.toxicity import toxicity

    docs = spark.createDataFrame([(d, f"some text {d} of plain words") for d in range(60)], "doc_id long, text string")
    for toxic in (0, 1):
        labels = spark.createDataFrame([(d, toxic) for d in range(60)], "doc_id long, toxic int")
        assert all(r.predicted == 0 and r.score < 1e-9 for r in toxicity(docs, labels).collect())


def test_packing_in_many_blocks(spark, sf):
    """Blocks of fifty pieces of the given texts: at most one sequence more than their tokens need, for each turn that is left."""
    from pyspark.sql import functions as F

    from matchgrid.llm import packing, queries
    from matchgrid.session import table

    docs = table(spark, sf, "documents")
    rows = packing.pack(docs, queries.tokenizer_path(), block_pieces=50).select("sequence_id", "offset", "length", "doc_id", "piece").collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) >= docs.select(F.countDistinct("doc_id")).first()[0]
    assert len(sequences) <= -(-sum(r.length for r in rows) // 4096) + 2
