"""Personal data, pages, quality rules, fingerprints, secrets and near-duplicates against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from framerank.llm import forest, neardup, sanitize, secretlinks, tagpaths
from framerank.llm.prefixhash import PrefixHash, edited, fingerprints, likeness

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(s[::-1])) % 10 == 0


digits = lambda m: re.sub(r"\D", "", m[0])
PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
)
SECRETS = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32),
)


def plain_spans(text, kinds):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))
    return [f"{kinds[k][0]}:{a}:{b}" for a, k, b in found]


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    bits = ["a", "b.c", "@", ".", "x@y.z", "1.2.3.4", "256", "+1 (222) 333-4444", "4111 1111 1111 1111", "-", " ", "\n", "0", "+", "9", "%", "é", "😀"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert sanitize.written(sanitize.base_spans(t)).split(",") == (plain_spans(t, PII) or [""]), repr(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + "." * 200_000, "a@" * 100_000, "@" * 200_000):
        sanitize.base_spans(t)


def test_disclosing_terms_are_found_and_copies_are_not_evidence(spark, docs, empty):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{noise(20)} Zebedee {noise(2)} zb@mail.example.org {noise(20)}") for i in range(8)]
    rows += [(100 + i, noise(60)) for i in range(120)] + [(300, f"{noise(9)} Zebedee {noise(9)}")]
    once = f"{noise(5)} Quillon qq@mail.example.org {noise(5)}"
    rows += [(400 + i, once) for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sanitize.find(table).collect()}
    assert got[300].n_terms == 1 and got[300].n_email == 0 and all(got[i].n_terms >= 1 for i in range(8))
    assert all(got[i].n_terms == 0 for i in range(400, 409)) and not any(got[i].spans for i in range(100, 220))
    clean = {r.doc_id: r.text for r in sanitize.sanitised(table).collect()}
    assert "Zebedee" not in clean[300] and "[EMAIL]" in clean[0] and clean[150] == dict(rows)[150]
    assert sanitize.find(empty).count() == 0 and sanitize.sanitised(empty).count() == 0


def plain_disclosing(texts):
    """Places as tuples of words, counted in sets."""
    places, joint, of_value, total = collections.defaultdict(set), collections.defaultdict(lambda: (set(), set())), collections.defaultdict(set), 0
    for text in set(texts):
        total += len(text.split())
        spans = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in plain_spans(text, PII))]
        at = 0
        for line in text.split("\n"):
            words = [(at + m.start(), m[0].lower()) for m in re.finditer(r"[^\W_]+(?:['’-][^\W_]+)*", line) if not any(a < at + m.end() and at + m.start() < b for a, _, b in spans)]
            place = [tuple(w for _, w in words[max(0, i - 2) : i + 3]) + (min(i, 2),) for i in range(len(words))]
            for i, (_, w) in enumerate(words):
                places[w].add(place[i])
            for a, k, b in spans:
                if at <= a < at + len(line) + 1 and b <= at + len(line):
                    value, i = (k, text[a:b].lower()), sum(x < a for x, _ in words)
                    around = (tuple(w for _, w in words[max(0, i - 2) : i]), tuple(w for _, w in words[i : i + 2]))
                    of_value[value].add(around)
                    for j in range(max(0, i - sanitize.REACH), min(len(words), i + sanitize.REACH)):
                        if len(words[j][1]) >= sanitize.LEAST_CHARS:
                            both = joint[value, words[j][1]]
                            both[0].add(place[j]), both[1].add(around)
            at += len(line) + 1
    out = set()
    for (value, term), both in joint.items():
        n = min(map(len, both))
        if n >= sanitize.SUPPORT and len(places[term]) <= n * max(1.0, total / len(of_value[value])) ** (1 - sanitize.THRESHOLD):
            out.add(term)
    return out


def test_disclosing_terms_match_a_plain_count(spark):
    rng, kinds = random.Random(21), set()
    for size in (60, 200):
        words = [f"w{i}" for i in range(40)] + ["Li", "x"] + ["z" * 194]
        names, values = [f"N{i}" for i in range(12)], [f"v{i}@mail.example.org" for i in range(12)] + ["10.0.0.1", "+1 (222) 333-4444"]
        rows = []
        for i in range(size):
            text = [rng.choice(words) for _ in range(rng.randint(3, 50))]
            for _ in range(rng.choice([0, 1, 1, 2])):
                k, at = rng.randrange(12), rng.randint(0, len(text))
                text[at:at] = [names[k], *rng.sample(words, rng.randint(0, 2)), values[k] if rng.random() < 0.8 else rng.choice(values)] if rng.random() < 0.7 else [names[k]]
            rows.append(rng.choice([" ", " ", ", "]).join(text).replace("w1 ", "\n"))
        rows += rows[:20]
        table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").cache()
        found = sanitize.disclosing(table, sanitize._scan(table))
        got = set() if found is None else {r.term for r in found.collect()}
        assert got == plain_disclosing(rows)
        kinds |= got
    assert {"li"} != kinds and len(kinds) > 3


def test_digests_of_awkward_documents(docs, empty):
    for rows, kinds in ((sanitize.find(docs), PII), (secretlinks.scan(docs), SECRETS)):
        got = sorted((str(r.doc_id), r.base_sha256) for r in rows.collect())
        want = sorted((str(d.doc_id), hashlib.sha256(",".join(plain_spans(d.text or "", kinds)).encode()).hexdigest()) for d in docs.collect())
        assert got == want
    assert secretlinks.scan(empty).count() == 0


def test_secret_spans_match_and_parts_are_linked(spark):
    rng = random.Random(3)
    bits = ["token", "password", "api_key", "API key", ": ", " = ", '"', "=", "abcdefgh", "short", "AKIA" + "Q" * 12, "AKIAX", "0a" * 16, "f" * 31, " ", "\n", "é", "😀", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secretlinks.scan(table).collect():
        want = plain_spans(texts[r.doc_id], SECRETS)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(filter(None, r.spans.split(","))), texts[r.doc_id]
    far = " " + "lorem " * 60
    cases = ["user: alice", "user: alice, pwd: hunter22", "user: alice" + far + "pwd: hunter22", "see https://db.example.org/x", "host: db.example.org pwd: hunter22", "pwd: hunter22", "user = bob token = abcdefgh12"]
    linked = {r.doc_id: r.n_linked for r in secretlinks.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert [linked[i] for i in range(len(cases))] == [0, 2, 0, 0, 2, 0, 1]


def test_secret_tokens_of_any_length(spark):
    rng = random.Random(4)
    signs = "abcXYZ019+/_-"
    tokens = ["aB3" + "".join(rng.choice(signs) for _ in range(n - 3)) for n in (23, 24, 25, 63, 64, 65, 86, 93, 400, 100_000)]
    tokens += ["x" * 90 + "B3", "B" * 90 + "a3", "3-" * 45 + "xB", "x3" * 40, "B3" * 40, "aB" * 40, "-" * 70 + "aB3"]
    texts = [f"account: shop {t} end" for t in tokens] + [f"host: db.example.org {tokens[6]}=="]
    got = {r.doc_id: r.spans for r in secretlinks.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(tokens):
        mixed = len(t) >= 24 and all(re.search(p, t) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        assert got[i] == (f"id:0:13,secret:14:{14 + len(t)}" if mixed else ""), t[:40]
    assert got[len(tokens)] == f"endpoint:0:20,secret:21:{21 + 86}"


def plain_links(spans, scope):
    """All pairs of parts, one by one."""
    near = lambda a, b: 0 <= b[1] - a[2] <= scope or 0 <= a[1] - b[2] <= scope
    over = lambda a, b: a[1] < b[2] and b[1] < a[2]
    kind = lambda x: "sisise"[x[0]]  # noqa: E731  classes by kind: the first three are base
    left = [a for a in spans if a[0] < 3 or not any(b[0] < 3 and over(a, b) for b in spans)]
    left = [a for a in left if a[0] != 4 or not any(b[0] in (3, 5) and over(a, b) for b in left)]
    return sorted(a for a in left if a[0] < 3 or any((kind(b) != "s" if kind(a) == "s" else kind(b) == "s") and near(a, b) for b in left if b != a))


def test_interval_join_matches_all_pairs(spark):
    rng, rows, want = random.Random(13), [], {}
    for row in range(400):
        found, spans = [], []
        for kind in range(6):
            at = 0
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                gap, length = rng.randint(0, 60), rng.randint(1, 25)
                found.append((kind, gap, length, True))
                spans.append((kind, at + gap, at + gap + length))
                at += gap + length
        rows.append((row, found))
        want[row] = plain_links(spans, 15)
    table = spark.createDataFrame(rows, "row long, found array<struct<kind:int,gap:int,len:int,ok:boolean>>")
    got = collections.defaultdict(list)
    for r in secretlinks.linked(table, 15).collect():
        got[r.row].append((r.kind, r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_parts_do_not_support_themselves(spark):
    cases = ["client_id=AbCdEf0123456789AbCdEf0123", "see https://example.org/Articles/2021/05/HelloWorldPost", "client_id=AbCdEf0123456789AbCdEf0123 https://example.org/Articles/2021/05/HelloWorldPost", "client_id=AbCdEf0123 pwd: hunter22"]
    got = {r.doc_id: r.spans for r in secretlinks.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == ["", "", "", "id:0:20,secret:21:34"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav><div class="cookie-notice">We use cookies, as you know. Accept them, please.</div>
%s<aside>Related, and more. So much more.</aside><form><label>Mail, please.</label><input name=q></form><section id=comments><p>Nice one, I say. Really.</p></section>
<footer>&copy; 2020, someone. All rights.</footer></body></html>"""


def test_main_text():
    body = "<article><h1>A title</h1><p>First &amp; long sentence, with   words\nand more. And a second, longer still.<p>Short.</p><ul><li>Item</ul></article>"
    want = "A title\nFirst & long sentence, with words and more. And a second, longer still.\nShort.\nItem"
    assert tagpaths.main_text(PAGE % body) == want
    assert tagpaths.main_text(PAGE % body.replace("article", "div")) == want
    assert tagpaths.main_text(None) == "" == tagpaths.main_text("<nav><a href=x>only a menu</a></nav>")
    assert tagpaths.main_text("plain, text.") == "plain, text."
    tagpaths.main_text("<div>" * 20_000 + "x" + "<p>" * 20_000 + "<a " * 20_000 + "<" * 20_000)


def test_ratios_decide_on_marked_paragraphs_of_an_article():
    text = "A sentence of the article, as long as the others are. And one more, for good measure."
    page = "<html><body><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><article><h1><a href=z>Title</a></h1>%s</article></body></html>"
    body = f"<p>{text}</p>" * 3
    assert tagpaths.main_text(page % (body + f'<p class="social-history">{text} It goes on, too.</p>')).endswith("It goes on, too.")
    assert tagpaths.main_text(page % (body + '<p class="share">Tell them</p>')) == "\n".join(["Title", *[text] * 3])
    assert tagpaths.main_text(page % (body + f'<div class="comments"><p>{text}</p></div><ul><li><a href=a>More of it</a><li><a href=b>And more</a></ul>')) == "\n".join(["Title", *[text] * 3])
    assert tagpaths.main_text(page % (body + '<ol><li>Item</ol>')) == "\n".join(["Title", *[text] * 3, "Item"])


def test_values_match_a_plain_computation():
    """Each path's ratios by one pass over all blocks for each block."""
    rng = random.Random(15)
    tags = ["<p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<a href=x>", "</a>", "<section>", "</section>", "<aside>", "</aside>", "<h2>", "</h2>", "<article>", "</article>", '<p class="ad">']
    for _ in range(300):
        page = "".join(rng.choice(tags) + rng.choice(["", "word ", "A sentence, with signs. ", "x" * 40]) for _ in range(rng.randint(1, 40)))
        blocks = tagpaths.Reader().read(page)
        tagpaths.fused(blocks)
        same = lambda b, c: (b.element.apart, b.element.path) == (c.element.apart, c.element.path)
        chars = [sum(len(c.text) for c in blocks if same(b, c)) / sum(same(b, c) for c in blocks) for b in blocks]
        stops = [1 + sum(c.stops for c in blocks if same(b, c)) / sum(same(b, c) for c in blocks) for b in blocks]
        free = [0 if b.element.apart else 1 - sum(min(c.linked, len(c.text)) for c in blocks if same(b, c)) / sum(len(c.text) for c in blocks if same(b, c)) for b in blocks]
        for i, b in enumerate(blocks):
            window = {i: 1.0} if b.element.weight < 1 else {j: math.exp(-((i - j) ** 2) / 2) for j in range(max(0, i - 3), min(len(blocks), i + 4))}
            smooth = [sum(w * x[j] for j, w in window.items()) / sum(window.values()) for x in (chars, stops)]
            assert b.value == pytest.approx(smooth[0] * math.sqrt(smooth[1]) * free[i] * b.element.weight)


def test_all_content_blocks_are_kept():
    long, short = "A sentence, as long as it is. " * 66, "And a short one, with a comma in it. " * 3
    paragraphs = f"<p>{long}</p><h2>Between</h2><p>{short}</p><p>{short}</p>"
    want = [long.strip(), "Between", short.strip(), short.strip()]
    assert tagpaths.main_text(f"<div>{paragraphs}</div>").split("\n") == want
    assert tagpaths.main_text(f"<nav>Menu</nav><div>{paragraphs}</div>").split("\n") == want
    # a third of the content lies in an article, the rest beside it
    parts = [f"Paragraph {i}, and more of it. " * 20 for i in range(6)]
    page = "<article>" + "".join(f"<p>{p}</p>" for p in parts[:2]) + "</article><div>" + "".join(f"<p>{p}</p>" for p in parts[2:]) + "</div><nav>Menu</nav>"
    assert tagpaths.main_text(page).split("\n") == [p.strip() for p in parts]


def test_scripts_end_at_their_end_tags():
    text = "The article, whole as it is. And its end."
    for junk in (
        "<script>for(i=0;i<n;i++)f(i);</script>", "<SCRIPT>a<b</Script >", "<style>a<b{}</style>", "<script>if(a<b)s='</scripts>'</script>", "<title>a <b c</title>", "<textarea>x <y</textarea>",
        "<datalist><option value=a><option value=b></datalist>", "<select><option>One<option>Two</select>", "<option value=a>", "<video src=v>", "<svg><style>a<b{}</style><path d=x /></svg>",
    ):
        assert tagpaths.main_text(f"{junk}<p>{text}</p>") == text, junk
    assert tagpaths.main_text(f"<p>{text}</p><script>never ended <p>Not, this.</p>") == text
    tagpaths.main_text("<video>" * 200_000 + "<script>" * 200_000)


def test_pages_with_nulls_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "y"), (2, "u", "<p>Hello, there. Yes.", "z")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in tagpaths.extract(rows).collect()) == [(1, "", 0), (2, "", 0), (2, "Hello, there. Yes.", 18)]
    assert tagpaths.extract(rows.where("false")).count() == 0


def test_rule_counts_match_plain_python():
    rng = random.Random(5)
    for _ in range(1500):
        t = "".join(rng.choice(["a ", "b ", "a b c d e f g h ", "é", "\n", "#", "x y\n", "\x0b", " "]) for _ in range(rng.randint(0, 30)))
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover))
        assert forest.statistics(t.encode())[0] == want, repr(t)


def test_scores_match_a_plain_walk():
    rng = np.random.default_rng(16)
    rows = rng.normal(size=(400, 4))
    rows[:, 3] = 1.0  # never varies
    trees = forest.Forest.fit(rows, seed=3, trees=12, sample=64, depth=6)
    new = np.concatenate([rows[:40], rng.normal(size=(40, 4)) * 3, [[0, 0, 0, 1], [9, 9, 9, 9]]])
    for row, score in zip(new, trees.score(new), strict=True):
        total = 0.0
        for t in range(12):
            node = 0
            while (f := trees.feature[t, node]) >= 0 and trees.low[t, node] <= row[f] <= trees.high[t, node]:
                node = trees.left[t, node] + (trees.low[t, node] < trees.high[t, node] and row[f] >= trees.split[t, node])
            total += trees.length[t, node]
        assert score == pytest.approx(2 ** (-total / 12 / trees.norm))
    assert trees.score(new)[-1] > trees.score(new)[:40].max()


def test_forest_tells_labelled_rows_apart(spark, sample, docs, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept = {r.doc_id: r.kept for r in forest.judge(sample, labels).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    bad, good = ([kept[d] for d, q in marks.items() if q == v] for v in (0, 1))
    assert sum(bad) / len(bad) < 0.1 and sum(good) / len(good) > 0.9
    assert sorted(r.doc_id for r in forest.keep_good(sample, labels).collect()) == sorted(d for d, k in kept.items() if k)
    none = labels.where("false")
    assert all(r.kept != r.base_failed for r in forest.judge(docs, none).collect())
    assert forest.judge(empty, labels).count() == 0 and forest.keep_good(docs, none).columns == docs.columns


def test_prefix_hashes_answer_span_questions():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 20))) for _ in range(2))
        x, y = PrefixHash(a), PrefixHash(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        want = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        assert x.extension(i, y, j) == want and x.same(i, y, j, want)
        assert (x.fingerprint() == y.fingerprint()) == (a == b)
        assert (x.span(i, i + want) == y.span(j, j + want))


def test_fingerprints_in_order(docs, empty, sample):
    for table in (docs, sample):
        rows = sorted(((r.doc_id if r.doc_id is not None else float("-inf"), r.text or "") for r in table.collect()), key=lambda r: -r[0])
        got = fingerprints(table).collect()
        assert len(got) == len(rows)
        by_id = collections.Counter(d for d, _ in rows)
        for r in got:
            d = r.doc_id if r.doc_id is not None else float("-inf")
            at = next(i for i, x in enumerate(rows) if x[0] == d)
            if by_id[d] == 1 and by_id[rows[(at + 1) % len(rows)][0]] == 1:
                new = edited(rows[at][1], rows[(at + 1) % len(rows)][1])
                assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(rows[at][1])
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprints(empty).count() == 0 and fingerprints(docs.where("doc_id = 4")).count() == 1
    assert likeness(PrefixHash("a" * 90).fingerprint(), PrefixHash("a" * 60 + "b" * 30).fingerprint()) > 0.5


def test_equal_middle_parts_count():
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900))
    spread = list(text)
    for i in range(10):
        spread[len(text) * (2 * i + 1) // 20] = "#"
    other = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900))

    def near(a, b):
        return likeness(PrefixHash(a).fingerprint(), PrefixHash(b).fingerprint())

    assert near(text, "#" + text[1:-1] + "#") > 0.95 and near(text, "".join(spread)) > 0.8 and near(text, "More before. " + text + " And after.") > 0.95
    assert near(text, other) < 0.05 and near("#" + text[1:], other + text[2000:]) > 0.25
    for t in ("", "x", "x" * 5000, "word " * 400, text, "é😀" * 30):
        lengths, spans = PrefixHash(t).anchored()
        at = [0, *itertools.accumulate(lengths.tolist())]
        assert at[-1] == len(t) and spans.tolist() == [PrefixHash(t[i:j]).span(0, j - i)[0] for i, j in itertools.pairwise(at)]


def plain_classes(rows, width, percent):
    def shingles(t):
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets = [shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                if x != y:
                    root[max((rows[x][0], x), (rows[y][0], y))[1]] = min((rows[x][0], x), (rows[y][0], y))[1]
    return sets, [rows[top(i)][0] for i in range(len(rows))]


@pytest.mark.parametrize("width", [2, 5])
def test_classes_match_all_pairs(spark, width):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    passage = " ".join(rng.choice(words) for _ in range(80))  # shared by texts that aren't alike enough
    for i in range(40):
        rows.append((n, passage + " " + " ".join(rng.choice(words) for _ in range(20 + i))))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, rows[0][1].upper())]
    sets, want = plain_classes(rows, width, 80)
    got = {r.doc_id: r for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()}
    assert [got[d].n_shingles for d, _ in rows] == list(map(len, sets))
    assert [got[d].component_id for d, _ in rows] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("quiet", [neardup.QUIET, None])
def test_groups_about_the_threshold(spark, quiet):
    """Copies of one text that are alike, or just not, to the text and to each other."""
    rng, rows = random.Random(11), []
    for size, changed in ((150, 5), (60, 7), (40, 3)) if quiet else ((20, 6),):
        base = [f"w{rng.randrange(4000)}" for _ in range(100)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(changed - 2, changed + 2)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(4000)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    chain = [f"c{i}" for i in range(100)]  # each version is alike to its neighbours only
    for k in range(30 if quiet else 6):
        rows.append(" ".join(chain))
        chain[3 * k : 3 * k + 3] = [f"n{k}.{j}" for j in range(3)]
    rows = list(enumerate(rows))
    _, want = plain_classes(rows, 2, 80)
    got = {r.doc_id: r.component_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 2, quiet=quiet).collect()}
    assert [got[d] for d, _ in rows] == want


def test_buckets_that_rounds_leave_are_compared_exactly(spark, monkeypatch):
    """Rounds that find nothing at all lose no link: neither that of classes nor that of the rows kept."""
    rng, rows = random.Random(3), []
    for size in (30, 12, 2):
        base = [f"w{rng.randrange(4000)}" for _ in range(80)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(1, 6)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(4000)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    monkeypatch.setattr(neardup, "LEAST_AGREED", neardup.BINS + 1)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, want = plain_classes(rows, 2, 80)
    got = {r.doc_id: r.component_id for r in neardup.classes(docs, 2).collect()}
    assert [got[d] for d, _ in rows] == want
    assert len(set(want)) < len(rows)
    _, want = plain_classes(rows, 5, 80)
    assert sorted(r.doc_id for r in neardup.keep_one(docs, 5).collect()) == sorted(set(want))


@pytest.mark.parametrize("exact", [4096, 0])
def test_small_clusters_have_one_round(spark, monkeypatch, exact):
    """After the first round what it leaves is compared exactly; only clusters above ``EXACT`` nodes have more rounds, and links are the same."""
    rng, rows, written = random.Random(8), [], []
    for _ in range(8):
        base = [f"w{rng.randrange(4000)}" for _ in range(80)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(3, 7)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(4000)}"
            rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    plain = neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df, name="cut": written.append(name) or plain(df, name))
    monkeypatch.setattr(neardup, "EXACT", exact)
    got = {r.doc_id: r.component_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert [got[d] for d, _ in rows] == plain_classes(rows, 2, 80)[1]
    assert "rest" in written and (written.count("candidates") == 1) == bool(exact)


def test_clusters_take_one_link_for_a_node(spark, monkeypatch):
    """A group whose nodes share forty buckets, each with a first node of its own, beside a pair."""
    rows = [(b, i) for b in range(neardup.BANDS) for i in (b, *range(100, 400))] + [(99, 1000), (99, 1001)]
    members = spark.createDataFrame([(b, i, i) for b, i in rows], "bucket long, id long, root long")
    links, plain = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda edges: links.append(edges.count()) or plain(edges))
    got = {r.id: r.cluster for r in neardup._clusters(members).collect()}
    assert got == {i: 1000 if i >= 1000 else 0 for _, i in rows}
    assert links == [300 + neardup.BANDS - 1 + 1]


def test_pairs_at_the_threshold_share_a_bucket():
    """The sketch's recall, measured: of pairs at a similarity of 0.8 none is without a common bucket or below the bins that must agree."""
    rng = np.random.default_rng(12)
    for size in (5, 9, 45, 180, 900):
        both = max(1, round(size * 0.8))
        for _ in range(400):
            each = rng.integers(0, 2**64, size, dtype=np.uint64)
            more = (size - both) // 2
            a, b = np.unique(each[: both + more]), np.unique(np.concatenate([each[:both], each[both + more :]]))
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                x, y = neardup.signature(a), neardup.signature(b)
                assert (neardup.buckets(x) == neardup.buckets(y)).any() and ((x & np.uint64(255)) == (y & np.uint64(255))).sum() >= neardup.LEAST_AGREED


def test_classes_of_awkward_documents(docs, empty):
    got = neardup.classes(docs, 2).collect()
    assert len(got) == docs.count() and {r.component_id for r in got if r.doc_id in (4, 5)} == {4} and {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    kept = neardup.keep_one(docs).collect()
    assert len({r.doc_id for r in kept}) == len(kept) and neardup.keep_one(docs).columns == docs.columns
    assert neardup.classes(empty, 2).count() == 0


def test_one_row_of_each_class_is_kept_whatever_its_id(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"{x}{rng.randrange(10_000)}" for _ in range(60)) for x in "abcde")
    near = a + " and more"  # a near copy of document 1, under the id of a text of its own
    rows = [(1, a), (2, near), (2, b), (None, c), (None, c), (None, d), (None, e), (3, e), (4, ""), (4, " "), (None, None), (2, b.upper())]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = collections.Counter((r.doc_id, r.text if r.text is None else r.text.lower()) for r in kept)
    assert got == collections.Counter([(1, a), (2, b), (None, c), (None, d), (3, e), (4, ""), (4, " "), (None, None)])
