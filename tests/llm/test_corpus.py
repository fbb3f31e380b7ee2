import collections
import hashlib
import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import components, fingerprints, leaks, lines, pieces, private, quality, queries, samples, similarity, suffixes, toxicity, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, first string, sig string, block int"


def rows(texts, start=0):
    """Documents with further columns whose names the operators use themselves."""
    return [(start + i, t, "en", "s", 0 if t is None else len(t), "x", "y", i) for i, t in enumerate(texts)]


EDGES = [None, "", " \n\t ", "x", "same text twice here", "same text twice here", "word " * 30000, "Ünï ﬁ ＡＢ İ́ 😀\nline"]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([*rows(EDGES), (None, None, None, None, None, None, None, None), (5, EDGES[5], None, None, None, None, None, None)], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_against_sql(spark):
    for name in queries.ORACLE_SQL:
        db = duckdb.connect()
        for t in ("documents", "pages"):
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = db.execute(queries.ORACLE_SQL[name])
        cols = [c[0] for c in found.description]
        assert sorted(repr(tuple(r[c] for c in cols)) for r in queries.QUERIES[name](spark, SF).collect()) == sorted(map(repr, found.fetchall()))


def test_line_templates(spark, edge):
    said = [f"Page {i} of 10 printed\nown words number {chr(97 + i)} here" for i in range(4)]
    got = lines.drop_recurring(spark.createDataFrame(rows(said), DOC), min_docs=3).orderBy("doc_id").collect()
    assert [r.n_dropped for r in got] == [0, 1, 1, 1] and got[1].text == "own words number b here" and got[0].text == said[0]
    kept = lines.drop_recurring(edge).collect()
    assert len(kept) == edge.count() and sum(r.text is None for r in kept) == 2
    assert lines.drop_recurring(edge.limit(0)).count() == 0


def test_lines_of_repeated_rows(spark):
    """Rows of one id are one document: a line that they alone repeat stays, and all with the least id keep theirs."""
    many = spark.createDataFrame([*[(1, "one line here now")] * 9, (2, "one line here now"), (None, "one line here now")], "doc_id bigint, text string")
    assert sum(r.n_dropped for r in lines.drop_recurring(many, min_docs=3).collect()) == 0
    assert sorted((r.doc_id or 0, r.n_dropped) for r in lines.drop_recurring(many, min_docs=2).collect()) == [(0, 1), *[(1, 0)] * 9, (2, 1)]


def test_long_lines(spark, edge):
    long, wide = " ".join(f"w{i}" for i in range(50)), "ab" * 150
    said = [f"{long}\nshort line", f"other\n{long}\nshort line", f"{long} more\n{wide}", f"{wide}\n{long}x", " " * 400, " " * 400]
    got = lines.drop_repeated(spark.createDataFrame(rows(said), DOC)).orderBy("doc_id").collect()
    assert [r.n_dropped for r in got] == [0, 1, 0, 1, 0, 0] and got[1].text == "other\nshort line" and got[3].text == f"{long}x"
    assert sum(r.text is None for r in lines.drop_repeated(edge).collect()) == 2 and lines.drop_repeated(edge.limit(0)).count() == 0


def test_pipeline_long_lines(spark, tmp_path):
    """A passage of two unlike documents stays in one of them, but a copy of a document goes whole."""
    import corpus_pipeline

    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    passage, own = prose(60), [prose(80) for _ in range(3)]
    said = [f"{own[0]}\n{passage}", f"{own[1]}\n{passage}", f"{own[1]}\n{passage}", own[2]]
    spark.createDataFrame([(1, "no such item here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows(said), DOC)
    for stage in (corpus_pipeline.line_stage, corpus_pipeline.near_stage, corpus_pipeline.leak_stage):
        docs = stage(spark, docs, str(tmp_path))
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {0: (said[0], len(said[0])), 1: (own[1], len(own[1])), 3: (own[2], len(own[2]))}


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(words, len(w))
        sets.append(frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, words, percent):
    r = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "One two", "one TWO", "a b c d e f"]
    for n in (6, 9, 20, 60, 150, 400):
        base = [r.choice(vocabulary) for _ in range(n)]
        for k in range(14):  # a family of near copies, some just over and some just under the limit
            own = list(base)
            for _ in range(r.randint(0, 1 + n // 40)):
                own[r.randrange(n)] = r.choice(vocabulary)
            texts.append(" ".join(own))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similarity.near_components(spark.createDataFrame(rows(texts), DOC), words, percent).collect()}
    assert got == brute_components(texts, words, percent)


def test_jaccard_panels(spark, monkeypatch):
    """Groups over the limits are screened in several panels, with the same result."""
    monkeypatch.setattr(similarity, "PANEL", 4)
    monkeypatch.setattr(similarity, "SMALL", 2)
    test_jaccard_join(spark, 4, 85)


def test_jaccard_edges(edge):
    got = similarity.near_components(edge).collect()
    assert len(got) == edge.count() and {r.component_id for r in got if r.doc_id == 5} == {4}
    assert similarity.near_components(edge.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30}


def test_fingerprints(spark, docs, edge):
    for df in (docs, spark.createDataFrame(rows(EDGES), DOC)):
        got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df, block=16).collect()}
        own = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
        canon, seen = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split()), {}
        for i, (d, t) in enumerate(own):
            nxt, h = own[(i + 1) % len(own)][1], len(t) // 2
            edited = t[: len(t) - h] + nxt[:h]
            assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert got[d].near_edited == (canon(t) == canon(edited)) and got[d].near_next == (canon(t) == canon(nxt))
            assert seen.setdefault(canon(t), got[d].fingerprint) == got[d].fingerprint
        assert len(set(seen.values())) == len(seen)
    assert fingerprints.edited_fingerprints(edge).count() == edge.count()
    assert fingerprints.edited_fingerprints(edge.limit(0)).count() == 0


def test_fingerprints_of_sparse_ids(spark, monkeypatch):
    """Ids all over 64 bits, negative and null ones: the chain goes through all rows once, by descending id."""
    monkeypatch.setattr(fingerprints, "WIDE", 4)
    r = random.Random(7)
    ids = [r.randrange(-(2**63), 2**63) for _ in range(60)] + list(range(-20, 20)) + [None] * 9
    many = [(x, f"text {i}") for i, x in enumerate(ids)]
    got = {(x.doc_id, x.text): x.next_text for x in fingerprints.with_next(spark.createDataFrame(many, "doc_id bigint, text string"), 16).collect()}
    known = sorted(((x, t) for x, t in many if x is not None), reverse=True)
    assert len(got) == len(many) and all(got[a] == b[1] for a, b in zip(known, known[1:], strict=False))
    at, seen, by_text = known[0], [], {t: (x, t) for x, t in many}
    for _ in many:
        seen.append(at)
        at = by_text[got[at]]
    assert at == known[0] and set(seen) == set(many) and [x for x, _ in seen[len(known) :]] == [None] * 9


def test_fingerprint_collisions(docs):
    """With a digest of three values nearly all buckets collide; comparing bytes keeps unlike texts apart."""
    poor = lambda c: F.struct((F.char_length(c) % 3).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    few = docs.where("doc_id < 40")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(few, digest=poor).collect()}
    canon = {r.doc_id: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", r.text).casefold()).split()) for r in few.collect()}
    assert len(set(got.values())) == len(set(canon.values()))
    assert all((got[a] == got[b]) == (canon[a] == canon[b]) for a in got for b in got)


def test_suffixes(spark, edge):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    shared = [word(45), word(60), "ab" * 40]
    texts = [None, "", "short", "a" * 130, "a" * 70] + [word(r.randint(0, 80)) + r.choice(shared) + word(r.randint(0, 40)) + r.choice(["", *shared]) for _ in range(40)]
    texts += texts[-3:]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffixes.remove_repeats(spark.createDataFrame(rows(texts), DOC), 40, gram=12).collect()}
    count = collections.Counter(t.encode()[p : p + 40] for t in map(lambda t: t or "", texts) for p in range(len(t.encode()) - 39))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 39):
            if count[raw[p : p + 40]] > 1:
                gone[p : p + 40] = [True] * 40
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        assert got[i] == (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)), i
    assert suffixes.remove_repeats(edge).count() == edge.count() and suffixes.remove_repeats(edge.limit(0)).count() == 0


def test_suffix_levels():
    """Many small batches through the levels give what one batch gives."""
    r = random.Random(3)
    word = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    gram = word(6)
    cuts = [(word(r.randint(0, 6)), gram + word(r.randint(0, 6))) for _ in range(60)]
    built = lambda xs: suffixes.Level.build(np.zeros(len(xs), np.int64), np.arange(len(xs)) + (0 if xs is cuts else base), np.ones(len(xs), int), [a for a, _ in xs], [b for _, b in xs], 12, 6)
    base, family = 0, suffixes.Family(12, 6)
    one = suffixes.Family(12, 6)
    one.add(built(cuts))
    for base in range(0, 60, 7):
        family.add(built(cuts[base : base + 7]))
    flat = lambda f: sorted(x for v in f.close() for x in zip(v.snip.tolist(), v.lo.tolist(), v.hi.tolist(), strict=True))
    assert flat(one) == flat(family) and len(family.levels) > 1


def test_leaks(spark, docs, edge):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "only")], "item_id bigint, text string")
    w = item.split()
    texts = [f"before {item} after", f"x {' '.join(w[:5] + ['NEW'] + w[6:])} y", " ".join(w[:8] + w[12:]) + " z", " ".join(w[:10]), "the only one", None]
    got = {(r.doc_id, r.item_id): r.distance for r in leaks.leaks(spark.createDataFrame(rows(texts), DOC), bench, block_chars=60).collect()}
    assert got == {(0, 1): 0, (1, 1): 1, (4, 3): 0}
    assert leaks.leaks(edge.limit(0), bench).count() == 0 and leaks.leaks(edge, bench.limit(0)).count() == 0
    r = random.Random(2)
    for _ in range(200):
        p, t = [r.choice("abc") for _ in range(r.randint(1, 8))], [r.choice("abcd") for _ in range(12)]
        cost = list(range(len(p) + 1))
        best = (99, 0)
        for j, c in enumerate(t, 1):
            prev, cost[0] = cost[:], 0
            for i in range(1, len(p) + 1):
                cost[i] = min(prev[i] + 1, cost[i - 1] + 1, prev[i - 1] + (p[i - 1] != c))
            best = min(best, (cost[-1], j))
        assert leaks.nearest(p, t, len(p)) == best and leaks.nearest(p, t, best[0] - 1) is None


def test_leaks_near_the_start():
    item = [f"w{i}" for i in range(59)]
    found = leaks.Matcher([(7, " ".join(item))], 15).find(" ".join(item[45:52] + item))
    assert found == [(7, 0, 66)]
    r = random.Random(8)
    for _ in range(1500):  # few words, so that pieces repeat
        p = r.choices("abc", k=r.randint(1, 24))
        t = r.choices("abcd", k=r.randint(0, 12)) + (p[r.randint(0, 8) :] if r.random() < 0.7 else []) + r.choices("abcd", k=r.randint(0, 12))
        for _ in range(r.randint(0, 3)):
            if t:
                t[r.randrange(len(t))] = "d"
        got = leaks.Matcher([(1, " ".join(p))], 15).find(" ".join(t))
        row = list(range(len(p) + 1))
        best = row[-1]
        for w in t:
            new = [0]
            for i, c in enumerate(p):
                new.append(min(row[i] + (c != w), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        assert [x[1] for x in got] == ([best] if best <= len(p) * 15 // 100 else [])


def test_pieces(spark, docs, edge):
    import sentencepiece

    path = queries.tokenizer_path()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, spark.createDataFrame(rows(EDGES), DOC)):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in pieces.encode(df, path).collect():
            t = texts[r.doc_id]
            assert list(r.ids) == lib.encode(t) and r.decoded == lib.decode(lib.encode(t))
            raw = t.encode()
            assert b"".join(raw[a:z] for a, z in zip(r.starts, r.ends, strict=True)) == raw
    assert pieces.encode(edge.limit(0), path).count() == 0


def test_pieces_of_the_vocabulary():
    """Pieces put together at random, with odd characters between them, and decoding of ids at random, as the library has them."""
    import sentencepiece

    model = open(queries.tokenizer_path(), "rb").read()
    lib, own, r = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Codec(model), random.Random(4)
    words = [lib.id_to_piece(i).replace("▁", " ") for i in range(lib.get_piece_size())]
    odd = lambda: chr(r.choice([r.randrange(128), r.randrange(32, 0xD7FF), r.randrange(0xE000, 0x110000)]))
    texts = ["".join(r.choice(words) if r.random() < 0.9 else odd() for _ in range(r.randint(1, 40))) for _ in range(1500)] + [" " * 30 + "x" + " " * 90, "a" * 5000, "ab" * 900, "▁" * 50]
    for t, (ids, starts, ends) in zip(texts, own.encode(texts), strict=True):
        assert ids == lib.encode(t) and own.decode(ids) == lib.decode(ids)
        assert b"".join(t.encode()[a:z] for a, z in zip(starts, ends, strict=True)) == t.encode()
    for _ in range(1500):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randint(0, 9))]
        assert own.decode(ids) == lib.decode(ids)


def test_character_map():
    """A map of the library's own, walked here, gives the library's normal form."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    proto = sentencepiece_model_pb2.ModelProto.FromString(lib.serialized_model_proto())
    spec = proto.normalizer_spec
    own = pieces.Normalizer(spec.precompiled_charsmap, True, True, True)
    for t in ("ＡＢＣ  ﬁ", "é ①", "  x  y ", "㌔", "plain", "  ", "日本 ｶﾞ"):
        raw = t.encode()
        normal, source = own(raw)
        assert normal.decode() == lib.normalize(t)
        assert len(source) == len(normal) + 1 and all(a <= b for a, b in zip(source, source[1:], strict=False))


def test_warc(spark):
    page = "<p>" + "é" * 600
    many = [(1, "u", page), (2, "u 2", page), (2, "u 2", page), (3, None, None), (4, "u", "short"), (5, "u", "short"), (None, "u", page)]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark.createDataFrame(many, "page_id bigint, url string, html string")).collect()), key=str)
    n = len(page.encode())
    assert got == sorted([(1, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None), (None, n, "revisit", 2)], key=str)
    b = warc.Bundle(frame_bytes=50)
    for i in range(9):
        b.add(i, warc.record(i, "u", "response", b"x" * i, "d", i, None))
    data, directory = b.close()
    table = warc.seek_table(data)
    assert len(table) > 3
    for e in reversed(directory):
        fields, block = warc.parse(warc.frame(data, table, e["frame"])[e["at"] : e["at"] + e["bytes"]])
        assert fields["WARC-Record-ID"] == f"<urn:page:{e['page_id']}>" and block == b"x" * e["page_id"]


def test_private(spark, edge):
    said = ["mail a.b+c@x-y.example.com now", "ip 1.2.3.4.5.6.7.8 and 999.1.1.1", "card 4111 1111 1111 1111 or 4111 1111 1111 1112", "call +1 (017) 555-7713 today", "phone (555) 010-9999 please", "write jane at example dot com", "on 2024-03-05 order 12-34-567", "a@b.c_d@e.f a@b x@y.z@w.v", None]
    found = private.find(spark.createDataFrame(rows(said), DOC))
    got = {r.doc_id: [(s.kind, said[r.doc_id][s.start : s.end], s.base) for s in r.spans] for r in found.collect()}
    assert got[0] == [("email", "a.b+c@x-y.example.com", True)] and got[1] == [("ip", "1.2.3.4", True), ("ip", "5.6.7.8", True)]
    assert got[2] == [("card", "4111 1111 1111 1111", True)] or ("card", "4111 1111 1111 1111", True) in got[2]
    assert got[3] == [("phone", "+1 (017) 555-7713", True)]
    assert [x[:2] for x in got[4]] == [("phone", "(555) 010-9999")] and [x[:2] for x in got[5]] == [("email", "jane at example dot com")] and got[6] == []
    assert got[7] == [("email", m, True) for m in ("a@b.c", "_d@e.f", "x@y.z")]
    assert {r.doc_id: r.text for r in private.redacted(found).collect()}[0] == "mail [email] now"
    assert private.digests(private.find(edge)).count() == edge.count()


def test_private_cards_and_ips(spark):
    said = ["order 12 4111 1111 1111 1111", "card 4111.1111.1111.1111 ok", "host 192[.]168[.]0[.]1 is up", "server 2001:db8:85a3:0:0:8a2e:370:7334 and fe80:12:9::1a2b.", "date 2024-03-05 12 17 at std::vector add::face", "12:30:45 and 1.5 2.5"]
    found = private.find(spark.createDataFrame(rows(said), DOC))
    got = {r.doc_id: [(s.kind, said[r.doc_id][s.start : s.end], s.base) for s in r.spans] for r in found.collect()}
    assert got[0] == [("card", "4111 1111 1111 1111", False)] and got[1] == [("card", "4111.1111.1111.1111", False)]
    assert got[2] == [("ip", "192[.]168[.]0[.]1", False)] and got[3] == [("ip", "2001:db8:85a3:0:0:8a2e:370:7334", False), ("ip", "fe80:12:9::1a2b", False)]
    assert got[4] == [] and got[5] == []
    assert private.redacted(found).where("doc_id = 0").first().text == "order 12 [card]"


def test_private_long_text(spark):
    """The time that a text takes grows little faster than its matches."""
    import time

    text = lambda n: " ".join(f"a{i}@b.org" for i in range(n))
    rows_ = spark.createDataFrame(rows([text(60000)]), DOC)  # over 700 KB
    began = time.time()
    got = private.digests(private.find(rows_)).first()
    spans = got.spans.split(",")
    assert got.n_email == 60000 and spans[1] == "email:9:17" and spans[-1] == f"email:{len(text(59999)) + 1}:{len(text(60000))}" and time.time() - began < 120


def test_private_base(docs):
    luhn = lambda d: sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in private.digests(private.find(docs)).collect():
        want = []
        for k, (name, p) in enumerate(patterns.items()):
            for m in re.finditer(p, texts[r.doc_id]):
                d = re.sub("[^0-9]", "", m[0])
                if name == "email" or (name == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (name == "card" and 12 <= len(d) <= 19 and luhn(d)) or (name == "phone" and 9 <= len(d) <= 15):
                    want.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(want)).encode()).hexdigest()


def test_classifiers(spark, docs, edge):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for module, label, least in ((quality, "quality", 0.95), (toxicity, "toxic", 0.93)):
        out = module.classify(big, labels).join(labels, "doc_id").where("held_out")
        right, n = out.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
        assert n > 500 and right >= least
    for module in (quality, toxicity):
        got = module.classify(edge, labels.limit(0)).collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)


def test_convolution():
    """Maxima over chunks as plain loops give them."""
    net, raw = quality.Network(3), [b"", b"ab", b"some bytes " * 90, bytes(range(256)) * 3]
    got, owner = net.pooled(raw)
    for i, x in enumerate(raw):
        x = x.ljust(quality.WIDTH, b"\0")
        resp = np.array([sum(net.table[j, x[p + j]] for j in range(quality.WIDTH)) + net.bias for p in range(len(x) - quality.WIDTH + 1)])
        whole = got[owner == i].max(0)
        assert np.allclose(whole, resp.max(0), atol=1e-4)  # the chunks cover all places


def test_toxic_rows():
    """Sparse products against a dense matrix."""
    texts = ["one two two", "", "Three one"]
    m, feats = toxicity.Rows.of(texts), toxicity.Features()
    dense = np.zeros((3, 1 << toxicity.BITS))
    for i, t in enumerate(texts):
        dense[i, feats(t)] = 1
    w, d = np.random.default_rng(1).normal(size=1 << toxicity.BITS), np.array([1.0, 2.0, -3.0])
    assert np.allclose(m.logits(w, 0.5), dense @ w + 0.5) and np.allclose(m.gradient(d), d @ dense)


def test_trained_models_on_edges(spark, docs, edge):
    """Models that were trained score empty, blank, repeated and very long texts, null ids, and no rows at all."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    many = docs.unionByName(docs)  # ids repeated
    for scored in (toxicity.score(edge, toxicity.fit(many, labels, positives=40, unlabeled=80)), quality.score(edge, quality.train(samples.labelled(many, labels, "quality", 4, 2, 30), 1))):
        got = scored.collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (4, 5)}) == 1
        assert scored.limit(0).count() == 0
    assert samples.labelled_rows(many, labels, "quality", 1, 4, 2, 5).count() == 5


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in out.collect()}
    assert 100 < len(kept) < docs.count()
    leaked = {r.doc_id for r in leaks.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("distance = 0").collect()}
    assert leaked and len(kept & leaked) <= len(leaked) // 10
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
