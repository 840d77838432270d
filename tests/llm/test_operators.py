"""Each operator on small tables: brute force, and nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import fuzzy_lines as fl, interpolated_lm as lm, language_bitmask as lb, latent_leaks as ll, piece_codec as pc, pseudonyms as ps, quality_rules as qr, reply_trees as rt, simhash_cover as sc, suffix_merge as sm
from gridloom.llm.queries import tokenizer

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, row string, n_words long, h long, kept string, bytes string, chunk string, fp string"


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def rows():
    base = [text(i, 60) + "\n" + text(i + 100, 12) for i in range(12)]
    near = base[0].split(" ")
    near[5] = "changed"
    texts = [*base, None, "", "   \n ", base[1], base[1], " ".join(near), "x" * 30_000, text(7, 8_000), "a▁ b\n\U0001f600 ", base[2] + "\n" + base[3]]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[3], (None, base[4])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "r", 1, 2, "k", "b", "c", "f") for i, t in rows()], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, none):
    got = qr.score_documents(docs).collect()
    assert len(got) == len(rows()) and all(not r.kept for r in got if r.n_words < 10)
    assert qr.filter_documents(docs).columns == docs.columns
    assert qr.filter_documents(none).count() == 0 and qr.score_documents(none).count() == 0


def test_repeated_words(spark):
    from pyspark.sql import functions as F

    def brute(w):
        at = {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        return len({p + k for x in at.values() if len(x) > 1 for p in x for k in range(5)})

    r = random.Random(1)
    data = [[r.choice("abc") for _ in range(r.randint(0, 40))] for _ in range(60)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(data)], "i int, w array<string>").select("i", qr.repeated_words(F.col("w")).alias("n"))
    assert {x.i: x.n for x in df.collect()} == {i: brute(w) for i, w in enumerate(data)}


def test_reply_trees(spark):
    said = ["<|a|>", "</s>[INST] \\ ok", "", "b<", "|>c\\"]
    m = [(1, 1, None, "user", said[0], 0.0), (1, 2, 1, "assistant", said[1], 0.1), (1, 3, 1, "assistant", said[2], 0.9), (1, 4, 3, "user|", said[3], 0.5), (1, 5, 4, None, said[4], 0.0), (2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0), (2, 3, 2, "user", "tail", 0.0), (None, 1, None, "user", None, None)]
    df = spark.createDataFrame(m, "tree_id long, message_id long, parent_id long, role string, text string, score double")
    from pyspark.sql import functions as F

    out = rt.format_conversations(rt.conversations(df, branches=5))
    got = out.select("tree_id", "leaf_id", "rank", rt.parse(F.col("formatted")).alias("t"), rt.loss_text(F.col("formatted"), F.col("loss")).alias("l")).collect()
    paths = {(r.tree_id, r.leaf_id): ([(x.role, x.text) for x in r.t], r.l, r.rank) for r in got}
    assert paths == {(1, 5): ([("user", said[0]), ("assistant", said[2]), ("user|", said[3]), ("", said[4])], "", 1), (1, 2): ([("user", said[0]), ("assistant", said[1])], said[1], 2), (None, 1): ([("user", "")], "", 1)}
    assert rt.format_conversations(rt.conversations(df.filter("false"))).count() == 0


def test_pieces(docs, none):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    run = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pc.encode_documents(docs.select("doc_id", "text"), path).collect():
        t = dict(rows()).get(r.doc_id) if r.doc_id is not None else rows()[-1][1]
        want = run.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.decoded == run.decode(want)
        spans = np.frombuffer(bytes(r.spans), "<i4").reshape(-1, 2)
        assert len(spans) == len(want) and spans[-1, 1] == len((t or "").encode()) and (spans[1:, 0] == spans[:-1, 1]).all()
    assert pc.encode_documents(none, path).count() == 0


def test_character_map():
    import sentencepiece

    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    model = pc.Model.parse(norm.serialized_model_proto())
    chars = pc.CharacterMap(model.charsmap)
    assert chars.longest("Ａx".encode(), 0) == (3, b"A") and chars.longest(b"x", 0) is None
    for t in ("ＡＢ ① ﬁx", "  a   b ", "ガ", "plain"):
        out, origin = pc.normalise(t.encode(), model)
        assert len(origin) == len(out) + 1 and (np.diff(origin) >= 0).all()
        assert out.decode().replace(pc.MARK, " ").strip() == norm.normalize(t).replace(pc.MARK, " ").strip()


def test_spans_through_a_character_map():
    """The vocabulary with another normaliser: spans are those that the library gives itself."""
    import sentencepiece

    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        base = f.read()
    spec = dict(pc.wire_fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    size, n = b"", len(spec)
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    model = pc.Model.parse(base + bytes([3 << 3 | 2]) + size + bytes([n]) + spec)
    codec = pc.Codec(model)
    assert model.charsmap and not codec.by_parts
    for t in ("ＡＢ ① ﬁx hello   wörld ", "  a   b ", "ガ plain ½", "", "x", "\U0001f600 ñ ﷺ end", "a\tb\n", "é" * 3000):
        ids = codec.ids(t)
        assert np.frombuffer(ids, "<u4").tolist() == codec.run.encode(t, add_bos=True, add_eos=True)
        got = np.frombuffer(codec.spans(t.encode(), ids), "<i4").reshape(-1, 2)[1:-1].tolist()
        assert got == [[p.begin, p.end] for p in codec.run.encode(t, return_type="proto").pieces], t


def test_pseudonyms(docs, none):
    key = b"k"
    t = "mail ann.lee7@host.example.org card 4539 1488 0343 6467 bad 4539 1488 0343 6468 ip 10.20.30.40 on 2021-03-04 or 31/12/1999 iban GB82 WEST 1234 5698 7654 32 call +1 (212) 555-0199 ssn 123-45-6789"
    new, found = ps.pseudonymise(t, key)
    assert found == {"email": 1, "iban": 1, "card": 1, "ssn": 1, "ipv4": 1, "date": 2, "phone": 1, "secret": 0}
    assert new == ps.pseudonymise(t, key)[0] and "4539 1488 0343 6468" in new and "ann.lee7" not in new
    for v in (list(range(7)), [3], []):
        n = [10] * len(v)
        assert ps.feistel(ps.feistel(v, n, key), n, key, inverse=True) == v
    assert len({tuple(ps.feistel([a, b], [10, 10], key)) for a in range(10) for b in range(10)}) == 100
    assert ps._card(ps._card("4539 1488 0343 6467", key, False), key, True) == "4539 1488 0343 6467"
    assert ps._date(ps._date("31/12/1999", key, False), key, True) == "31/12/1999"
    assert ps.pseudonymise_documents(docs.select("doc_id", "text"), "k").count() == len(rows()) and ps.pseudonymise_documents(none, "k").count() == 0


def test_language(spark, none):
    from pyspark.sql import functions as F

    r = random.Random(3)
    make = lambda a: " ".join("".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(40))
    data = [(i, make("abcdeé") if i % 2 else make("xyzwvu"), "p" if i % 2 else "q") for i in range(60)]
    df = spark.createDataFrame([*data, (60, None, "p"), (61, "1 2 !", "q"), (62, data[0][1], None)], "doc_id long, text string, lang string")
    model = lb.learn(df, F.col("doc_id"))
    got = {x.doc_id: x.lang_pred for x in lb.predict_documents(df.select("doc_id", "text"), model).collect()}
    assert all(got[i] == x for i, _, x in data) and got[60] == got[61] == "und" and got[62] == "q"
    empty = lb.learn(df.filter("false"), F.col("doc_id"))
    assert {x.lang_pred for x in lb.predict_documents(df.select("doc_id", "text"), empty).collect()} == {"und"}
    assert lb.predict_documents(none.select("doc_id", "text"), model).count() == 0


def test_simhash(docs, none, monkeypatch):
    monkeypatch.setattr(sc, "PART_HOMES", 3)
    for most in (sc.SINGLE_MOST, 5):
        monkeypatch.setattr(sc, "SINGLE_MOST", most)
        got = sc.cluster_documents(docs.select("doc_id", "text")).collect()
        fps = [r.fp & (1 << 64) - 1 for r in got]
        comp = list(range(len(fps)))
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    a, b = comp[i], comp[j]
                    comp = [b if c == a else c for c in comp]
        for r, c in zip(got, comp, strict=True):
            assert r.component_id == min((x.doc_id for x, d in zip(got, comp, strict=True) if c == d and x.doc_id is not None), default=None)
    assert sc.drop_near_copies(docs).columns == docs.columns and sc.drop_near_copies(none).count() == 0


@pytest.mark.parametrize("hot", [sm.HOT, 0, 2])
def test_suffixes(docs, none, monkeypatch, hot):
    monkeypatch.setattr(sm, "HOT", hot)
    first = {}
    big = 1 << 60
    data = [(big if i is None else i, (t or "").encode()) for i, t in rows()]
    for i, t in data:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            first[w] = min(first.get(w, big), i)
    got = sorted(((big if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in sm.remove_repeats(docs).collect()))
    want = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        want.append((i, len(t), int(gone.sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    assert got == sorted(want) and sm.remove_repeats(none).count() == 0


def test_lines(docs, none):
    out = fl.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows()) and fl.drop_lines(none).count() == 0
    lines = [x for r in out.collect() if r.text is not None for x in r.text.split("\n") if x.strip(" \t")]
    sets = [{x[i : i + fl.SHINGLE] for i in range(max(1, len(x) - fl.SHINGLE + 1))} for x in lines]
    again = [(i, j) for i in range(len(sets)) for j in range(i) if lines[i] != lines[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert not again


def test_language_model(spark, docs, none):
    from pyspark.sql import functions as F

    part = docs.select("doc_id", "text")
    got = lm.score_documents(part, F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 1).collect()
    assert len(got) == len(rows()) and all(r.score < 0 and np.isfinite(r.score) for r in got)
    counts = {}
    for i, t in rows():
        if i is not None and i % 3:
            for w in [*(t or "").encode().lower().split(), "end"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        if r.doc_id is None:
            continue
        toks = [*(dict(rows())[r.doc_id] or "").encode().lower().split(), "end"]
        assert r.n_tokens == len(toks) and r.train_tokens == n and r.n_known == sum(w in counts for w in toks)
        assert abs(r.base_score - sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in toks)) < 1e-6
    assert lm.score_documents(none.select("doc_id", "text"), F.lit(True), F.lit(False)).count() == 0
    weights = lm.learn_weights([(3, 10, 0.5, 0.1), (3, 5, 0.0, 0.2)], 100)
    assert np.allclose(weights.sum(1), 1) and (weights[1:] > 0).all()


def test_leaks(spark, docs, none):
    items = [(1, text(900, 30)), (2, text(901, 50)), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = items[1][1].split(" ")
    del near[10:14]
    more = spark.createDataFrame([(500, text(1, 40) + " " + items[0][1].upper() + "! " + text(2, 70)), (501, text(3, 90) + "\n" + " ".join(near)), (502, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in ll.find_leaks(docs.select("doc_id", "text").union(more), bench).collect()}
    assert got == {(500, 1), (501, 2)}
    assert ll.find_leaks(none.select("doc_id", "text"), bench).count() == 0 and ll.find_leaks(more, bench.filter("false")).count() == 0
    assert ll.drop_leaked(more, bench).collect()[0].doc_id == 502


def test_leaks_in_many_documents(spark):
    items = [(1, text(900, 30)), (2, "alpha1 beta2 gamma3 delta4 " * 8)]
    filler = lambda i: "".join(f"word{i}x{k} " for k in range(40))
    data = [(i, filler(i) + (items[0][1] if i % 3 == 0 else items[1][1] if i % 3 == 1 else "none") + " " + filler(i + 3000)) for i in range(3000)]
    got = ll.find_leaks(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i % 3 + 1) for i in range(3000) if i % 3 < 2}


def test_leaks_of_paraphrases(spark):
    r = random.Random(11)
    items = [(i, text(2000 + i, r.randint(20, 60))) for i in range(120)]
    data, want = [], set()
    for i, t in items:
        w = t.split(" ")
        for k in range(3):
            kept = [x if j >= len(w) - 5 or r.random() < 0.6 else f"other{r.randint(0, 500)}" for j, x in enumerate(w)]
            same = sum(a == b for a, b in zip(kept, w, strict=True))
            if same >= 0.55 * len(w):
                want.add((3 * i + k, i))
            data.append((3 * i + k, text(3 * i + k, r.randint(0, 90)) + " " + " ".join(kept) + " " + text(5000 + i, 60)))
    got = ll.find_leaks(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 200 and want <= {(x.doc_id, x.item_id) for x in got}


def test_lines_with_a_changed_character(spark):
    r = random.Random(4)
    lines = ["".join(r.choice("abcdefghij klmnop") for _ in range(r.randint(60, 118))) for _ in range(60)]
    changed = [x[: len(x) // 2] + "7" + x[len(x) // 2 + 1 :] for x in lines]
    sets = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    assert all(len(sets(x) & sets(y)) >= 0.8 * len(sets(x) | sets(y)) for x, y in zip(lines, changed, strict=True))
    out = fl.drop_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(changed))], "doc_id long, text string"))
    assert {x.doc_id: x.text for x in out.collect()} == {1: "\n".join(lines), 2: ""}


def test_short_lines(spark):
    data = [(1, "all rights reserved.\nok\n\n \t\none"), (2, "All rights reserved.\n\n \t\nok\ntwo"), (3, "three\n ok \nall rights reserved")]
    out = fl.drop_lines(spark.createDataFrame(data, "doc_id long, text string"))
    assert {x.doc_id: x.text for x in out.collect()} == {1: data[0][1], 2: "\n \t\ntwo", 3: "three"}


def test_minima_by_classes(spark):
    r = random.Random(6)
    sets = {h: [r.randrange(-(2**63), 2**63) for _ in range(n)] for h, n in enumerate([1, 2, 3, 5, 9, 30, 200])}
    got = fl.minima(spark.createDataFrame([(h, x) for h, xs in sets.items() for x in xs + xs[:2]], "h long, x long")).collect()
    known = [t << fl.LOW_BITS | fl.LOWS[i] for t, i in fl.PLACES]
    assert len(set(known)) == len(known) == fl.ROWS * fl.GROUPS
    # the class of a hash, then its last LOW_BITS
    code = lambda x: (x % 2**64) >> (64 - fl.CLASS_BITS) << fl.LOW_BITS | x % 2**fl.LOW_BITS
    assert {x.h: [x[f"m{j}"] for j in range(len(known))] for x in got} == {h: [min(code(x) ^ c for x in xs) for c in known] for h, xs in sets.items()}


def test_pairs_of_short_lines_at_the_threshold(spark):
    """Four of five shingles in common: 0.94 of these pairs shared a bucket when each band took its values from all shingles alike."""
    r = random.Random(8)
    lines = ["".join(r.sample("abcdefghijklmnopqrstuvwxyz0123456789", 9)) for _ in range(1500)]
    out = fl.drop_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(x[:8] for x in lines))], "doc_id long, text string"))
    texts = {x.doc_id: x.text for x in out.collect()}
    assert texts[1] == "\n".join(lines) and len(texts[2].split()) <= 0.015 * len(lines)


def test_sketches_make_each_set_once(spark, capsys):
    made = fl.sketched(spark.createDataFrame([(1, "some line")], "h long, code string").select("h", fl.shingles(F.col("code")).alias("x")))
    made.explain()
    assert "Filter" not in capsys.readouterr().out and [r.n for r in made.collect()] == [5]


def test_lines_in_lower_case(spark):
    """Lower case is made of whole texts: a final sigma ends where its line does, and only white space of the word definition is blank."""
    texts = ["\u039f\u0394\u039f\u03a3\n\u0391\u03a3 \n \x0b\f\r\n\u00a0\n\u0130X\n\u3000", "\u03bf\u03b4\u03bf\u03c2"]
    got = fl.line_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", "doc_id").collect()
    assert {(x.doc, x.line_no, x.line) for x in got} == {(0, 0, "\u03bf\u03b4\u03bf\u03c2"), (0, 1, "\u03b1\u03c2"), (0, 3, "\u00a0"), (0, 4, "i\u0307x"), (0, 5, "\u3000"), (1, 0, "\u03bf\u03b4\u03bf\u03c2")}


def test_pipeline_near_copies(spark):
    import corpus_pipeline

    def changed(t, n):
        w = t.split(" ")
        for k in range(n):
            w[10 + 14 * k] = f"changed{k}"
        return " ".join(w)

    base = [text(7000 + i, 200) for i in range(40)]
    data = [(i, base[i]) for i in range(40)] + [(100 + i, changed(base[i], 2 + i % 3)) for i in range(40)] + [(200, changed(base[0], 12)), (None, base[1]), (201, None), (202, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert {r.doc_id for r in got} == {*range(40), 200, None, 201}
