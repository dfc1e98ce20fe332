"""Tokenizer, contamination and languages."""

import json
import random

import pytest

from skein.llm import bpe, contamination, langid

ALPHABET = "ab c'd\n"


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    """A small byte-level BPE vocabulary, its merges drawn at random."""
    rng = random.Random(8)
    names = {b: c for c, b in bpe._byte_names().items()}
    vocab = {names[b]: b for b in range(256)}
    merges, tokens = [], [names[ord(c)] for c in ALPHABET]
    while len(merges) < 60:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in vocab and len(a + b) < 9:
            vocab[a + b] = len(vocab)
            merges.append(f"{a} {b}")
            tokens.append(a + b)
    path = tmp_path_factory.mktemp("v") / "v.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    return str(path)


def slow(model, word):
    ids = [model.byte_id[b] for b in word.encode()]
    while True:
        ranks = [(model.rank_of[a * model.size + b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a * model.size + b in model.rank_of]
        if not ranks:
            return ids
        r, i = min(ranks)
        ids[i : i + 2] = [model.made[r]]


def test_words_as_merged(vocabulary):
    model, rng = bpe.Bpe(vocabulary), random.Random(1)
    words = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 14))) for _ in range(4000)] + ["a" * 3000, "é中🙂"]
    want = [slow(model, w) for w in words[:-2]]
    assert model.words(words)[:-2] == want and [model.exact(w.encode()) for w in words[:-2]] == want
    assert model.words(words)[-1] == model.exact("é中🙂".encode())


def test_encoding(spark, vocabulary):
    texts = [(1, None), (2, ""), (3, "ab c'd <|endoftext|>"), (4, "a" * 50_000), (3, "ab c'd <|endoftext|>"), (None, " \n\n a")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode(df, vocabulary).collect()]
    assert len(got) == len(texts) and dict(got)[1] == [] and dict(got)[2] == []
    model = bpe.Bpe(vocabulary)
    assert bytes(b for i in dict(got)[4] for b in _bytes(model, i)).decode() == "a" * 50_000
    assert bpe.encode(df.limit(0), vocabulary).count() == 0


def _bytes(model, token):
    return next(raw for raw, i in model.vocab.items() if i == token)


def test_public_vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    try:
        t = tokenizers.Tokenizer.from_file(path)
    except Exception:
        pytest.skip("no vocabulary here")
    t.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["".join(rng.choice("etaoin shrdlu .,'\n\té中🙂́ 9") for _ in range(rng.randrange(200))) for _ in range(500)] + ["don't <|endoftext|>  \n x", "\u2028²½Ⅷ_a"]
    ids, ends = bpe.Bpe(path).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


WORDS = [f"{a}{b}" for a in "ka lo mi nu re so ta vi wo xe ye za bri dro flu".split() for b in "nel dar gos tip mur fen lak sor".split()]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def leaks(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in contamination.leaked(d, e).collect())


def test_leaks(spark):
    rng = random.Random(6)
    order = "Read the note below and answer the question in one word.\n"
    items = {i: passage(rng, 90) for i in range(8)}
    rows = [(i, order + " ".join(w)) for i, w in items.items()] + [(20, " ".join(items[3]).upper()), (21, None), (22, " \n"), (23, order)]
    other = lambda n: " ".join(passage(rng, n))
    half = items[0][20:70]
    faulty = [w if k % 8 != 5 else "zzz" for k, w in enumerate(items[1][10:60])]
    missing = [w for k, w in enumerate(items[2][:64]) if k % 8 != 3]
    often = [w if k % 3 else "zzz" for k, w in enumerate(items[4])]
    marked = "".join(f"// <b>{w}</b>,&nbsp;{'​' if k % 5 else chr(10) + '> '}" for k, w in enumerate(items[3][30:66]))
    docs = [
        (1, other(30) + " " + " ".join(half) + " " + other(30)), (2, other(10) + " " + ", ".join(faulty)), (3, " ".join(missing)), (4, marked), (5, " ".join(often)), (6, " ".join(items[5][:20]) + " " + other(60)),
        (7, " ".join(items[5][:16]) + " " + other(40) + " " + " ".join(items[5][40:56])), (8, None), (9, ""), (10, order * 40), (11, other(4000) + " " + " ".join(items[6]) + " " + other(4000)), (12, " ".join(items[7])), (12, " ".join(items[7])),
    ]
    assert leaks(spark, docs, rows) == [(1, 0), (2, 1), (3, 2), (4, 3), (4, 20), (11, 6), (12, 7)]


def test_leaks_of_empty_tables(spark):
    assert leaks(spark, [], [(1, "a b c d e f g")]) == [] and leaks(spark, [(1, "a b")], []) == []


def test_short_items(spark):
    assert leaks(spark, [(1, "x one two three y"), (2, "one x two"), (3, "x")], [(1, "One, two: three!")]) == [(1, 1), (2, 1)]  # a third is one word
    assert leaks(spark, [(1, "x one two three y"), (2, "one x two")], [(1, "One, two: three! Four.")]) == [(1, 1)]


def test_leaks_to_the_letter(spark):
    """A third of the words, one fault in eight of the passage, neither more nor less."""
    rng = random.Random(11)
    w = [[f"w{i}x{k}" for k in range(30)] for i in range(6)]
    other = lambda n: " ".join(passage(rng, n))
    items = [(i, " ".join(x[:9] if i == 0 else x)) for i, x in enumerate(w)]
    put = lambda x, *at: ["zzz" if k in at else y for k, y in enumerate(x)]
    docs = [
        (1, other(9) + " " + " ".join(w[0][2:5]) + " " + other(9)), (2, other(9) + " " + " ".join(w[0][2:4]) + " " + other(9)),  # three and two of nine words
        (3, other(9) + " " + " ".join(w[1][4:12]) + " " + other(9)), (4, other(9) + " " + " ".join(w[1][4:13]) + " " + other(9)), (5, " ".join(w[1][20:])),  # eight of thirty, nine and a fault at the end, ten
        (6, " ".join(put(w[2][:10], 3, 6))), (7, " ".join(put(w[2][:16], 3, 12))), (8, " ".join(put(w[2][:16], 2, 7, 12))),  # two faults in ten, two and three in sixteen
        (9, " ".join(w[3][:5] + ["zzz"] + w[3][5:10])), (10, " ".join(w[3][:5] + w[3][6:12])),  # a word between is no fault that is allowed, a missing one is
    ]
    assert leaks(spark, docs, items) == [(1, 0), (4, 1), (5, 1), (7, 2), (10, 3)]


def stands(doc, item):
    """Brute force: every window of the item at every place of the document."""
    need = -(-len(item) // 3)
    for a in range(len(item)):
        for b in range(a + need, len(item) + 1):
            for p in range(len(doc) + 1):
                row = {p: 0}  # end of the passage: faults
                for x in item[a:b]:
                    after = {}
                    for q, f in row.items():
                        after[q] = min(after.get(q, 99), f + 1)
                        if q < len(doc):
                            after[q + 1] = min(after.get(q + 1, 99), f + (doc[q] != x))
                    row = after
                if 8 * min(row.values()) <= b - a:
                    return True
    return False


def test_leaks_as_brute_force(spark):
    rng = random.Random(5)
    few = [f"v{i}" for i in range(14)]
    items, docs = {}, {}
    for i in range(12):
        items[i] = [rng.choice(few) for _ in range(rng.randrange(1, 30))]
    for d in range(50):
        w = items[rng.randrange(12)]
        a = rng.randrange(len(w))
        part = w[a : a + rng.randrange(1, 26)]
        docs[d] = [rng.choice(few) for _ in range(rng.randrange(4))]
        docs[d] += [y for y in (rng.choice(few) if rng.random() < 0.09 else x for x in part) if rng.random() > 0.05] + [rng.choice(few) for _ in range(rng.randrange(4))]
    want = sorted((d, i) for d, x in docs.items() for i, w in items.items() if stands(x, w))
    assert leaks(spark, [(d, " ".join(x)) for d, x in docs.items()], [(i, " ".join(w)) for i, w in items.items()]) == want and len(want) > 40


def test_instructions_of_any_length():
    rng = random.Random(3)
    short, long = "Translate:", " ".join(passage(rng, 80)) + "."
    rest = [passage(rng, 12) for _ in range(9)]
    rows = [(i, short + " " + " ".join(rest[i])) for i in range(3)] + [(i, long + "\n" + " ".join(rest[i])) for i in range(3, 6)]
    rows += [(i, "the " + " ".join(rest[i])) for i in range(6, 9)]  # a word that items begin with is no instruction
    got = {i[0]: w for w, i in contamination.bodies(rows).items()}
    assert got == {i: tuple(w if i < 6 else ["the", *w]) for i, w in enumerate(rest)}


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_WORDS", 40)
    rng = random.Random(2)
    items = {i: passage(rng, 30) for i in range(5)}
    assert leaks(spark, [(i, " ".join(w)) for i, w in items.items()], [(i, " ".join(w)) for i, w in items.items()]) == [(i, i) for i in range(5)]


SPEECH = {
    "en": "the nightly job writes every file only when all of them have been read and nothing else waits for it".split(), "de": "der nächtliche Lauf schreibt jede Datei erst wenn alle gelesen wurden und nichts anderes mehr auf ihn wartet".split(),
    "fr": "le travail de nuit écrit chaque fichier seulement quand tous ont été lus et que rien ne attend plus".split(), "nl": "de nachtelijke taak schrijft elk bestand pas als ze allemaal gelezen zijn en niets anders meer wacht".split(),
}


def said(rng, code, n=24):
    return " ".join(rng.choice(SPEECH[code]) for _ in range(n)) + "."


def test_languages(spark):
    rng = random.Random(4)
    docs = [(1000 + i, code if rng.random() > 0.2 else rng.choice(list(SPEECH)), "\n\n".join(said(rng, code) for _ in range(3))) for i, code in enumerate(list(SPEECH) * 60)]
    truth = {i: c for (i, *_), c in zip(docs, list(SPEECH) * 60)}
    more = [
        (1, None, "# Titel\n\n" + said(rng, "de") + "\n\n```\nthe code\n\nis the code\n```\n\n" + said(rng, "en") + "\n\n" + said(rng, "de")), (2, "English", said(rng, "en")), (3, "en-GB", said(rng, "en")), (4, "n/a", said(rng, "fr")),
        (5, "de", None), (6, "de", ""), (7, None, "# only\n\n```\nx\n```"), (8, "ja", said(rng, "nl")), (9, "de", "1234 5678\n\n---"), (10, "deu", "\r\n".join([said(rng, "de"), "", said(rng, "nl"), "", said(rng, "de")])),
    ]
    df = spark.createDataFrame([(*d, 1) for d in docs + more], "doc_id long, lang string, text string, block_no int")
    out = langid.languages(df).collect()
    got = {(r["doc_id"], r["block_no"]): r["lang"] for r in out if r["is_case"]}
    few = {k: v for k, v in got.items() if k[0] < 1000}
    assert few == {(1, -1): "de", (1, 4): "en", (4, -1): "fr", (8, -1): "nl", (10, 1): "nl"}
    whole = {r["doc_id"]: r["lang"] for r in out if r["block_no"] == -1}
    right = sum(whole.get(i) == c for i, c in truth.items())
    assert right >= 0.98 * len(truth)
    assert all(0 <= r["confidence"] <= 1 for r in out)
    assert langid.languages(df.limit(0)).count() == 0


def test_labels():
    assert [langid.label(x) for x in ("EN", "pt-BR", "zh_CN", "Deutsch", "fra", "und", "", None, "ja", " English ")] == ["en", "pt", "zh", "de", "fr", None, None, None, "ja", "en"]
