"""What tasks hold, share and start: cases behind findings on time and memory."""

import random

import numpy as np
from plans import planned

from tideline.llm import language_model, licences, packing, queries, recurrent, simhash
from tideline.llm.texts import lane_table


def test_words_learned_are_shared_and_bounded(monkeypatch):
    path = queries.word_tokenizer()
    assert packing.word_encoder(path) is packing.word_encoder(path)
    monkeypatch.setattr(packing, "WORDS_HELD", 40)
    draw = random.Random(3)
    letters = "abcdeàéßÄ'1,."
    words = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 9))) for _ in range(300)]
    encoder = packing.WordEncoder(path)
    for _ in range(30):
        texts = [" ".join(draw.choices(words, k=draw.randrange(0, 12))) for _ in range(4)] + [None, "", "the the the"]
        plain = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert encoder.encode(texts) == plain
        assert len(encoder.held.older) < 40 + 200
    frequent = packing.HeldWords(lambda word: word)
    asked = []
    frequent.learn = lambda word: asked.append(word) or word
    for at in range(100):
        frequent.trim()
        assert (frequent[b"the"], frequent[b"%d" % at]) == (b"the", b"%d" % at)
        assert len(frequent) + len(frequent.older) <= 2 * 22
    assert asked.count(b"the") == 1


def test_known_licences_start_no_python(spark):
    known = licences.known_licences(spark)
    assert "ExistingRDD" not in planned(known) and "Python" not in planned(known)
    assert {r["licence"] for r in known.collect()} == {name for name, _ in licences.LICENCES + licences.NOTICES}
    assert licences.known_licences(spark, ()).count() == 0


def test_words_of_a_batch_are_learned_at_once():
    names = [language_model.hashed(w) for w in (b"", b"the", b"of")]
    counts = {names[0]: 9, names[1]: 7, names[2]: 5, language_model.hashed(b"rare"): 2}
    shape = recurrent.Shape(3, (0, 1), language_model.TAIL_CLASSES)
    tails = np.arange(language_model.TAIL_CLASSES, dtype=float)
    model = language_model.LanguageModel(shape, {}, {key: i for i, key in enumerate(names)}, counts, 3 * tails, tails, 23, 4)
    coder, seen = language_model.Coder(model), []
    for texts in (["the rare of", None], [], ["new the new rare", "thé of"]):
        codes = [coder.codes(t if t is None else t.encode()) for t in texts]
        coder.learn()
        assert len(coder.input) == len(coder.hash) == len(coder.known) == len(coder.base) == len(coder.own)
        for text, found in zip(texts, codes, strict=True):
            for word, code in zip(language_model.words_of(text and text.encode()), found.tolist(), strict=True):
                key, tail = language_model.hashed(word), language_model.tail_class(word)
                count = counts.get(key)
                base = 0.0 if count is None else np.log10(count + 0.5)
                own = 0.0 if key in names else base - np.log10(3 * tail + 0.5 * (tail + 1))
                number = names.index(key) if key in names else 3 + tail
                seen.append(word)
                assert (coder.input[code], coder.hash[code], coder.known[code]) == (number, key, count is not None)
                assert (coder.base[code], coder.own[code]) == (base, own)
    assert len(coder.input) == len(set(seen))


def test_fingerprint_keys_are_made_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TEXTS", 3)
    monkeypatch.setattr(simhash, "TASK_PRINTS", 40)
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(200)]
    texts = [" ".join(draw.choices(words, k=30)) for _ in range(120)] + [None, "", "one word"]
    texts += [texts[i] + " more" for i in range(0, 100, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = simhash.fingerprints(docs)
    lanes = lane_table()
    assert {r["doc_id"]: r["fp"] for r in prints.collect()} == {i: simhash.fingerprint(t, 4, lanes) for i, t in enumerate(texts)}
    classes = prints.select("fp").distinct()
    keys = simhash._bucketed(classes)
    assert keys.rdd.getNumPartitions() == -(-classes.count() // 40)
    assert keys.distinct().count() == keys.count()
    values = np.array(sorted(r["fp"] for r in classes.collect()), dtype=np.int64)
    found, rows = simhash.bucket_keys(values, simhash.golay_tables())
    assert {(r["key"], r["fp"]) for r in keys.collect()} == set(zip(found.tolist(), values[rows].tolist(), strict=True))


def test_training_words_of_a_batch_get_their_numbers_at_once(spark, monkeypatch):
    monkeypatch.setattr(language_model, "hashes", lambda words, f=language_model.hashes: asked.append(list(words)) or f(asked[-1]))
    asked, end = [], language_model.hashed(b"")
    outputs = {end: 0, language_model.hashed(b"the"): 1}
    words = ["the rare of", "", "the rare", "\xa0new of"]
    learned = language_model.input_numbers([b"the", b"of", b""], language_model.hashes([b"the", b"of", b""]), outputs)
    assert learned.tolist() == [1, 2 + language_model.tail_class(b"of"), 0] and len(asked) == 1
    docs = spark.createDataFrame([(t,) for t in words], "text string")
    rows = language_model._coded(docs, outputs, 2, "text").collect()
    numbers = language_model.numbers_of(outputs)
    expected = [np.array([numbers[w] for w in language_model.words_of(t.encode())], dtype=np.uint16).tobytes() for t in words]
    assert sorted(bytes(r["tokens"]) for r in rows) == sorted(expected)


def test_fingerprint_keys_move_once(spark, monkeypatch):
    plans, write = {}, simhash.written
    monkeypatch.setattr(simhash, "written", lambda frame, path: plans.update({path.rsplit("/", 1)[1]: planned(frame)}) or write(frame, path))
    prints = spark.createDataFrame([(0,), (1,), (-1,)], "fp long")
    found = {row["fp"]: row["root"] for row in simhash.link_fingerprints(prints).collect()}
    assert found[0] == found[1] != found[-1] and plans["members"].count("hashpartitioning(key") == 1
