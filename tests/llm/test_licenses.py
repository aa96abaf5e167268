import random
import re

from corpusloom.llm import licenses as li


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, lab) for k in range(len(words)) for p, lab in li.BASE.items() if words[k : k + len(p.split())] == p.split()]
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force(spark, odd_docs, clashing, no_docs, odd_rows):
    want = sorted(((r[0], *brute(r[1])) for r in odd_rows), key=repr)
    for docs in (odd_docs, clashing):
        out = li.scan_licenses(docs).collect()
        assert sorted((tuple(r)[:6] for r in out), key=repr) == want
        for r in out:
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert li.scan_licenses(no_docs).count() == 0


def test_templates_and_key_phrases(spark):
    rows = [(i, f"prose before {text.title()} and after") for i, (_, text, _) in enumerate(li.TEMPLATES)]
    rows += [(100, "license the under licensed version apache"), (101, "Licensed under CC BY-NC 4.0."), (102, "plain prose of no licence " * 50), (103, "license " * 3000)]
    out = {r["doc_id"]: r for r in li.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, text, phrases) in enumerate(li.TEMPLATES):
        if any(p in text for p in phrases):
            assert label in out[i]["labels"].split(","), (label, out[i])
            assert out[i]["score"] > 0.99
    assert out[100]["labels"] == out[102]["labels"] == out[103]["labels"] == ""
    assert out[101]["labels"] == "cc-by,cc-by-nc"


def test_file_of_every_notice(spark):
    held = [(label, text) for label, text, phrases in li.TEMPLATES if any(p in text for p in phrases)]
    rows = [(1, " prose between the notices ".join(text for _, text in held)), (2, "plain prose")]
    out = {r["doc_id"]: r for r in li.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {label for label, _ in held} <= set(out[1]["labels"].split(","))
    assert out[1]["score"] > 0.99 and out[2]["labels"] == ""


def brute_labels(text, index, templates=li.TEMPLATES):
    """Labels and score of one text, template by template and shift by shift."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    held = lambda phrase: any(words[k : k + len(phrase.split())] == phrase.split() for k in range(len(words)))
    labels, score = {lab for p, lab in li.BASE.items() if held(p)}, 0.0
    for t, (label, notice, phrases) in enumerate(templates):
        mine = [(w, at, share) for w, of, at, share in index if of == t]
        matched = max((sum(x for w, at, x in mine if 0 <= k + at < len(words) and words[k + at] == w) for k in range(-len(notice.split()), len(words))), default=0.0)
        if matched >= li.MIN_SCORE and any(map(held, phrases)):
            labels.add(label)
            score = max(score, min(1.0, round(matched, 9)))
    return ",".join(sorted(labels)), score


def test_labels_and_score_against_brute_force(spark, odd_rows):
    r = random.Random(8)
    vocabulary = sorted({w for _, text, _ in li.TEMPLATES for w in text.split()})
    texts = [x[1] for x in odd_rows if len(x[1] or "") < 5000]
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 4)):
            w = r.choice(li.TEMPLATES)[1].split()
            for _ in range(r.choice([0, 0, 1, 3, 6])):  # words changed, dropped or moved
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1)
            parts.append(" ".join(w))
            parts.append(" ".join(r.choice(["prose", "of", "the", "license", "gpl", "Version"]) for _ in range(r.randint(0, 9))))
        texts.append(r.choice([" ", "\n", ", "]).join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = li.postings(li.word_idf(docs))
    out = {x["doc_id"]: (x["labels"], x["score"]) for x in li.scan_licenses(docs).collect()}
    for i, text in enumerate(texts):
        want = brute_labels(text, index)
        assert out[i][0] == want[0] and abs(out[i][1] - want[1]) < 1e-6, (text, out[i], want)
    assert sum("," in a for a, _ in out.values()) > 20
