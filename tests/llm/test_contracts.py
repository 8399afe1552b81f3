"""Registered queries against independent versions, and rows that are null, empty, blank, very long, equal or oddly named."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordlink.llm import bpe, common, jaccard, mixing, passages, quality, secrets, toxicity, urls, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, row string, best string, digest string, score string"


def documents(folder=SF):
    return duckdb.sql(f"select doc_id, text, lang, source from '{folder}/documents.parquet'").fetchall()


def odd_rows():
    r = random.Random(5)
    words = [f"w{i}" for i in range(600)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [some(120) for _ in range(12)]
    texts += [texts[0], texts[1].replace(texts[1].split()[60], "changed"), None, "", " \n\t ", "one two", "one two", some(30_000), "x" * 300_000, "\n".join(["same line of a text with seven words"] * 30), "#$% " * 80]
    rows = [(i, t, [None, "en", "fr"][i % 3], ["a", "b", None][i % 3], len(t or ""), "x", "y", "z", "b", "d", "s") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id here at all", "en", "a", 1, "", "", "", "", "", "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    return {r["doc_id"]: r for r in rows if r["doc_id"] is not None}


# ---- op1 --------------------------------------------------------------------------------------------


def test_mixing_query(spark):
    rows = mixing.query(spark, SF).collect()
    src = {d: (s, len(WORD.findall(t or ""))) for d, t, _, s in documents()}
    sizes: dict = {}
    for s, n in src.values():
        sizes[s] = sizes.get(s, 0) + n
    assert len(rows) == len(src)
    taken: dict = {}
    for r in rows:
        s, n = src[r.doc_id]
        assert r.size == n and r.source_size == sizes[s] and r.taken in (0, n, 2 * n)
        taken.setdefault(s, [0, r.target, 0])
        taken[s][0] += r.taken
        taken[s][2] = max(taken[s][2], n)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want, left, open_ = {}, 1.5 * sum(sizes.values()), names
    while open_:  # targets again, by the contract's words
        weight = sum((3, 1, 2)[names.index(s) % 3] for s in open_)
        over = [s for s in open_ if left * (3, 1, 2)[names.index(s) % 3] / weight > 2 * sizes[s]]
        want |= {s: 2.0 * sizes[s] for s in over} if over else {s: left * (3, 1, 2)[names.index(s) % 3] / weight for s in open_}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in over] if over else []
    for s, (n, target, largest) in taken.items():
        assert target == pytest.approx(want[s]) and abs(n - target) <= largest
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.query(spark, SF).collect()))  # reruns agree


def _cheapest(pat, cells, want, repeats=2):
    """Cost of a min-cost flow, word by word over Bellman-Ford paths."""
    arcs = []

    def arc(u, v, c, w):
        arcs.extend(([u, v, c, w], [v, u, 0, -w]))

    for p in pat:
        for cost, c in mixing.passes(pat[p], sum(repeats * n for (q, _), n in cells.items() if q == p)):
            arc("S", ("p", p), c, cost)
    for (p, s), n in cells.items():
        arc(("p", p), ("s", s), repeats * n, 0)
    for s, n in want.items():
        arc(("s", s), "T", round(n), 0)
    cost = 0
    while True:
        dist, via = {"S": 0}, {}
        for _ in range(40):
            for i, (u, v, c, w) in enumerate(arcs):
                if c > 0 and u in dist and dist[u] + w < dist.get(v, 1e9):
                    dist[v], via[v] = dist[u] + w, i
        if "T" not in dist:
            return cost
        cost, v = cost + dist["T"], "T"
        while v != "S":
            i = via[v]
            arcs[i][2] -= 1
            arcs[i ^ 1][2] += 1
            v = arcs[i][0]


def test_flow_is_cheapest():
    r = random.Random(1)
    for _ in range(30):
        names = "abc"[: r.randrange(1, 4)]
        cells = {(p, s): r.randrange(1, 9) for k in range(1, len(names) + 1) for p in itertools.combinations(names, k) if r.random() < 0.7 for s in p}
        pat = {p: max(1, max(n for (q, _), n in cells.items() if q == p) - r.randrange(3)) for p in {q for q, _ in cells}}
        size = {s: n for s in names if (n := sum(n for (_, x), n in cells.items() if x == s))}
        if not size:
            continue
        want = mixing.targets(size)
        flow = mixing.route(pat, cells, want)
        assert all(sum(v for (_, x), v in flow.items() if x == s) == round(want[s]) for s in size)
        cost = 0
        for p in pat:
            n = sum(v for (q, _), v in flow.items() if q == p)
            for each, cap in mixing.passes(pat[p], sum(2 * x for (q, _), x in cells.items() if q == p)):
                cost, n = cost + each * min(n, cap), n - min(n, cap)
        assert cost == _cheapest(pat, cells, want)


def test_overlaps_change_the_mix(spark):
    """A text of both sources is shared, so that each source takes its own words before words are repeated; ties, equal rows, other names and null texts do no harm."""
    rows = [(i, f"only a {i} " + "x " * 20, "a") for i in range(60)] + [(100 + i, f"both {i} " + "y " * 20, s) for i in range(60) for s in ("a", "b")] + [(500, None, "c"), (501, "tie tie", None), (501, "tie tie", None)]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, source string, pattern string, cell int")
    got = mixing.mix(docs, docs.columns).collect()
    assert len(got) == len(rows) and all(0 <= r.times <= 2 for r in got) and [r.times for r in got if r.row.text is None] == [0]
    for s in ("a", "b"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.times for r in mine) - mine[0].target) <= 30
    passes: dict = {}
    for r in got:
        if r.source in ("a", "b"):
            passes[r.row.text] = passes.get(r.row.text, 0) + r.times
    assert max(passes.values()) <= 3  # without sharing a text of both could be passed four times while others wait
    assert len({r.times for r in got if r.row.doc_id == 501}) == 1
    also = docs.withColumn("also", F.when(F.col("source") == "a", F.array(F.lit("b"))))
    assert len(mixing.mix(also, ["doc_id"], also="also").collect()) == len(rows)


def test_rare_patterns_lose_no_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 1)
    rows = [(i * 10 + j, f"text {i} " + "z " * (5 + i), s) for i in range(40) for j, s in enumerate(["a", "b", "c"][: 1 + i % 3])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()
    for s in ("a", "b", "c"):
        mine = [r for r in got if r.source == s]
        assert sum(r.size for r in mine) == mine[0].source_size and abs(sum(r.size * r.times for r in mine) - mine[0].target) <= 60


# ---- op2 --------------------------------------------------------------------------------------------


def test_quality_of_odd_rows_is_the_sqls(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, quality.query(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(quality.SQL).fetchall(), key=repr)
    assert len(got) == len(odd_rows()) and all(not r[7] for r in got if r[1] == 0)


def test_fences_find_odd_documents_in_small_and_large_groups(spark):
    r = random.Random(2)
    clean = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(300))
    bad = lambda: " ".join(w + "###" for w in clean().split())
    rows = [(i, clean(), "en", "big") for i in range(400)] + [(1000 + i, clean(), "en", "small") for i in range(12)] + [(2000, bad(), "en", "big"), (2001, bad(), "en", "small"), (2002, bad(), "fr", None)]
    got = {x.row.doc_id: x.kept for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert [k for k, v in got.items() if not v and k < 2000] == [] and not got[2000] and not got[2001] and not got[2002]


# ---- op3, op4 -----------------------------------------------------------------------------------------


def test_secret_query(spark):
    assign = re.compile(r"""(?P<k>[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""")
    got = by_id(secrets.query(spark, SF).collect())
    for d, t, _, _ in documents():
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m["v"]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[d]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_tokens_query(spark):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = by_id(bpe.query(spark, SF).collect())
    for d, t, _, _ in documents():
        ids = enc.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_secrets_and_tokens_of_odd_rows(odd, none):
    texts = [r[1] for r in odd_rows()]
    got = secrets.scan(odd, odd.columns, redact=True).collect()
    assert sorted((r.row.text or "", r.redacted or "") for r in got) == sorted((t or "", t or "") for t in texts) and all(not r.spans for r in got if not (r.row.text or "").strip())
    got = bpe.tokens(odd, odd.columns, *bpe.public_vocabulary(), want=("n_tokens", "decoded")).collect()
    assert sorted((r.row.text or "", r.decoded) for r in got) == sorted((t or "", t or "") for t in texts)
    assert secrets.scan(none, ["doc_id"]).collect() == [] == bpe.tokens(none, ["doc_id"], *bpe.public_vocabulary()).collect()


# ---- op6, op8 -----------------------------------------------------------------------------------------


def test_passages_query(spark):
    """All repeated windows of 50 words are covered, and all paragraph groups are those of exact Jaccard components."""
    from tests.llm.test_passages import brute

    docs = [(d, t) for d, t, _, _ in documents()]
    rows = passages.query(spark, SF).collect()
    for d, words in brute(docs).items():
        mine = [(r.start, r.end) for r in rows if r.doc_id == d and r.kind == "span"]
        assert all(any(a <= x and y <= b for a, b in mine) for x, y in words)
    units = [(d, i, s, e, _set(t[s:e])) for d, t in docs for (_, i, s, e, _) in _units(t)]
    ids: dict = {}
    for d, i, *_ , s in units:
        ids.setdefault(frozenset(s), []).append((d, i))
    sets = list(ids)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where: dict = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    for a, b in {p for ks in where.values() for p in itertools.combinations(ks, 2)}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups: dict = {}
    for k, s in enumerate(sets):
        groups.setdefault(find(k), []).extend(ids[s])
    want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    got: dict = {}
    for r in rows:
        if r.kind == "line":
            got.setdefault(r.cluster, []).append((r.doc_id, r.para))
    found = {tuple(sorted(g)) for g in got.values()}
    assert len(found & set(map(tuple, want))) >= 0.98 * len(want) and all(sum(not r.removed for r in rows if r.kind == "line" and r.cluster == c) == 1 for c in got)


def _set(t):
    w = [x.lower() for x in WORD.findall(t or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _units(t):
    for found, _, _ in passages._paragraphs([t]):
        yield from found


def test_short_lines_join():
    got = [(a, b) for _, _, a, b, _ in _units("one two three\nfour five\n" + "word " * 30 + "\nlast of all five words")]
    assert len(got) == 2 and got[0][0] == 0
    assert list(_units("a b c")) == [] == list(_units(None)) and len(list(_units("a b c d e"))) == 1


def test_ids_that_repeat_keep_their_texts(spark):
    """Of equal rows one stays, different texts under one id stay, null ids stay, and the smallest row of each group."""
    r = random.Random(4)
    text = lambda: " ".join(f"q{r.randrange(9999)}" for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (1, a), (2, a), (3, c), (None, c), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((x.doc_id or 0), x.text or "") for x in jaccard.stage(spark, docs, "").collect())
    assert got == sorted([(1, a), (1, b), (3, c), (0, c), (4, ""), (4, ""), (5, "")])


# ---- op7, op9 -----------------------------------------------------------------------------------------


def test_vectors_match_brute_force(spark):
    r = random.Random(6)
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(80)]
    rows = [(i, b) for i, b in enumerate(base)] + [(1000 + i, [x + r.gauss(0, 0.05) for x in base[i % 20]]) for i in range(120)] + [(2000, base[0]), (2000, base[0]), (2001, base[0][:8])]
    cos = lambda x, y: len(x) == len(y) and sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    links = [[j for j in range(len(rows)) if j != i and cos(rows[i][1], rows[j][1]) >= 0.9] for i in range(len(rows))]
    comp = list(range(len(rows)))
    for _ in range(8):
        for i, js in enumerate(links):
            for j in js:
                comp[i] = comp[j] = min(comp[i], comp[j])
    want = sorted((rows[i][0], len(links[i]), min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i])) for i in range(len(rows)))
    docs = spark.createDataFrame([(*x, "a", 1) for x in rows], "vec_id long, embedding array<double>, c string, links int")
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in vectors.near_duplicates(docs).collect()) == want


def test_urls_of_odd_rows(spark):
    rows = [(1, "http://X.example.org/es/1?q"), (1, "http://X.example.org/es/1?q"), (2, None), (3, ""), (4, "://"), (5, "http://a.com" + "/fr/" * 5000), (6, "http://org/"), (7, "http://.org/")]
    df = spark.createDataFrame([(i, u, "b", "r", "v", "h", "p") for i, u in rows], "page_id long, url string, best string, rule string, verdict string, host string, path string")
    rules = urls.rule_table(spark, [*urls.RULES, ("example.org", "/es/", "allow"), ("", "/", "block"), (None, "/", "block")])
    got = sorted((r.row.page_id, r.rule, r.verdict, r.row.best) for r in urls.judge(df, rules, df.columns).collect())
    assert got == [(1, "example.org/es/", "block", "b")] * 2 + [(2, None, "allow", "b"), (3, None, "allow", "b"), (4, None, "allow", "b"), (5, "com/fr/", "allow", "b"), (6, "org/", "allow", "b"), (7, "org/", "allow", "b")]
    assert urls.judge(df.limit(0), rules, ["page_id"]).collect() == []
    assert {r.verdict for r in urls.judge(df, rules.limit(0), ["page_id"]).collect()} == {urls.DEFAULT}


# ---- op10 ---------------------------------------------------------------------------------------------


def _labelled(spark):
    """Toxic documents speak of one group more often than clean ones do, in each of two languages."""
    r = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        term = ("muslim" if i % 2 else "juif") if r.random() < (0.9 if toxic else 0.1) else ("christian" if i % 2 else "noir")
        words = [r.choice(["river", "house", "tree", "road", "light"] if i % 2 else ["maison", "arbre", "route", "fleuve"]) for _ in range(12)]
        words += [r.choice(["idiot", "trash"]) if r.random() < 0.5 else "quiet"] if toxic else []
        rows.append((i, ("the " if i % 2 else "les ") + " ".join(words) + f". the {term} and les {term} of the town."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_counterfactuals_close_the_gap(spark):
    docs, labels = _labelled(spark)
    probe = spark.createDataFrame([(i, f"the house and the river of the {t}") for i, t in enumerate(("muslim", "christian"))] + [(2 + i, f"les maison et les route du {t}") for i, t in enumerate(("juif", "noir"))], "doc_id long, text string")
    gaps = {}
    for swap in (0.0, 50.0):
        model = toxicity.train(docs, labels, swap=swap)
        assert model[2] > 500  # counterfactuals were made
        s = {r.row.doc_id: math.log(r.score / (1 - r.score)) for r in toxicity.score(probe, ["doc_id"], model).collect()}
        gaps[swap] = max(s[0] - s[1], s[2] - s[3])
    assert gaps[0.0] > 1 and gaps[50.0] < gaps[0.0] / 4


def test_sentences_and_languages():
    made = list(toxicity.counterfactuals("The muslim of the town. Nothing here"))
    assert ("muslim", "jewish") in made and ("muslim", "jüdisch") not in made and [old for old, _ in made].count(None) == 1
    inserted = list(toxicity.counterfactuals("der hund und die katze."))
    assert inserted and inserted[0][0] is None and inserted[0][1] in toxicity.IDENTITY["de"]
    assert list(toxicity.counterfactuals(None)) == [] == list(toxicity.counterfactuals(" .. "))


def test_toxicity_of_odd_rows(spark, odd, none):
    docs, labels = _labelled(spark)
    for lab in (labels.limit(0), labels.filter("toxic = 1"), labels.union(labels).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))):
        model = toxicity.train(docs, lab)
        got = toxicity.score(odd, odd.columns, model).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if not (r.row.text or "").strip()}) == 1
    assert toxicity.score(none, ["doc_id"], model).collect() == []


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # some 3,000 labelled rows to learn from; sf0.01 has 300
    labels = {r[0]: r[1] for r in duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall()}
    rows = toxicity.query(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for y, p in held if y) >= 0.85 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 0.01 * len(held)


# ---- pipeline -----------------------------------------------------------------------------------------


def test_pipeline(spark):
    """The rows that each stage keeps and the ids of its texts, by other means than the stages."""
    import tiktoken

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({quality.SQL}) where kept").fetchall()}
    docs = {d: (t, s) for d, t, _, s in documents() if d in kept}
    sets = {d: _set(t) for d, (t, _) in docs.items()}
    group = {d: d for d in docs}
    for _ in range(6):
        for a, b in itertools.combinations(sorted(docs), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    stay = {d for d in docs if group[d] == d}
    path, pattern = bpe.public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = corpus_pipeline.run(spark, SF).collect()
    times: dict = {}
    for r in rows:
        t, s = docs[r.doc_id]
        clean = secrets.redacted(t, secrets.scan_text(t)[1])
        assert r.doc_id in stay and r.source == s and list(r.ids) == enc.encode_ordinary(clean) and r.decoded_sha256 == hashlib.sha256(clean.encode()).hexdigest()
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2
    size = {d: len(WORD.findall(secrets.redacted(docs[d][0], secrets.scan_text(docs[d][0])[1]))) for d in stay}
    whole: dict = {}
    for d in stay:
        whole[docs[d][1]] = whole.get(docs[d][1], 0) + size[d]
    for s, want in mixing.targets(whole).items():
        assert abs(sum(size[d] * times.get(d, 0) for d in stay if docs[d][1] == s) - want) <= max(size[d] for d in stay if docs[d][1] == s)


def test_pipeline_takes_odd_rows(spark, odd, none, tmp_path):
    for docs, name in ((odd, "odd"), (none, "none")):
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        whole = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_tokens == len(r.ids) and r.doc_id in whole for r in got)
        assert all(len(WORD.findall(whole[r.doc_id] or "")) >= 50 for r in got)  # what the base rules reject is gone, and nothing is taken more than twice
        assert max([0, *Counter(r.doc_id for r in got).values()]) <= 2 and (name == "none") == (not got)


def test_forget(spark):
    df = common.written(spark.range(3), "some")
    assert df.count() == 3 and common._folders
    kept = list(common._folders)
    common._folders[:] = kept[-1:]
    common.forget(spark)
    common._folders[:] = kept[:-1]
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(kept[-1]).count()
