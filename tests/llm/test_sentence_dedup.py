import random
import re

from corpus import SF, docs, prose  # noqa: F401

from starmill.llm import sentence_dedup as s
from starmill.llm.queries import QUERIES


def brute(texts):
    """Sentence numbers covered by a non-first run of any width, for ``{key: text}``: single sentences
    of 20 words, pairs and triples of 10, and longer runs where three hold fewer."""
    first, gone = {}, {}
    for key in sorted(texts):
        parts = [p.lower().split() for p in re.findall(r"[^\n.!?]+[.!?]*", texts[key] or "")]
        parts = [p for p in parts if p]
        sizes = list(map(len, parts))
        for at in range(len(parts)):
            for end in range(at + 1, min(at + 10, len(parts)) + 1):
                held = sum(sizes[at:end])
                needless = end - at > 3 and held - max(sizes[at], sizes[end - 1]) >= 10
                if held >= (20 if end - at == 1 else 10) and not needless:
                    name = tuple(map(tuple, parts[at:end]))
                    if first.setdefault(name, (key, at)) != (key, at):
                        gone.setdefault(key, set()).update(range(at, end))
    return gone


def test_whole_table_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    expected = brute(texts)
    rows = QUERIES["op7_sentence_dedup"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(expected)
    for r in rows:
        text, gone = texts[r.doc_id], expected[r.doc_id]
        sentences = s.sentences(text)
        assert r.n_removed == len(gone) and r.n_sentences == len(sentences)
        spans = [tuple(map(int, p.split(":"))) for p in r.spans.split(",")]
        for number, (start, end, _) in enumerate(sentences):
            assert any(a <= start and end <= b for a, b in spans) == (number in gone)
        assert r.doc_id not in r.first_in or len(r.first_in) > 1 or r.n_removed < len(sentences)


def test_passages_are_cut_out_once(docs):
    passage = prose(1, 70)
    texts = [f"{prose(10 + i, 33)}. {passage}. {prose(50 + i, 33)}." for i in range(5)]
    long = " ".join(prose(90, 80).replace(".", "").split()) + "."
    texts += [prose(77, 200), f"Alone here. {long}", f"{long} Other end.", None, "", "a. b. c. a. b. c."]
    rows = {r.doc_id: r for r in s.remove_repeats(docs(texts)).collect()}
    assert set(rows) == {1, 2, 3, 4, 7} == set(brute(dict(enumerate(texts))))
    for i in range(1, 5):
        assert passage not in rows[i].text and rows[i].first_in == [0]
        assert prose(50 + i, 33) in rows[i].text
    assert rows[7].text == "Other end."


def test_null_and_repeated_keys(docs):
    text = prose(3, 80)
    frame = docs([(None, text), (4, text), (4, text), (4, prose(4, 90))]).withColumnRenamed("lang", "key")
    rows = s.remove_repeats(frame).collect()
    assert [(r.doc_id, r.first_in, r.n_removed == r.n_sentences) for r in rows] == [(4, [], True)] * 2
    assert s.remove_repeats(docs([])).count() == 0


def removed_words(text, left):
    return len(text.split()) - len(left.split())


def test_passages_of_very_short_sentences_are_found(docs):
    """Any three sentences hold under ten words; exact copies and passages are cut whole."""
    lines = "\n".join(f"line{k} of verse{k}" for k in range(40))
    shouted = " ".join(f"word{k}!!" for k in range(60))
    tail = "nine short words stand here before the very end. " + " ".join(f"x{k}." for k in range(9))
    texts = [lines, lines, shouted, f"Other start here. {shouted} Another end."]
    texts += [f"{prose(1, 40)}. {tail}", f"{prose(2, 40)}. {tail} Last."]
    rows = {r.doc_id: r for r in s.remove_repeats(docs(texts)).collect()}
    assert set(rows) == {1, 3, 5}
    assert rows[1].text == "" and rows[1].n_removed == 40 and rows[1].first_in == [0]
    assert rows[3].text == "Other start here. Another end." and rows[3].n_removed == 60
    assert rows[5].text == f"{prose(2, 40)}. Last."


def test_longer_runs_cover_every_passage():
    """Each sentence of a stretch of enough words is in a run that lies within the stretch."""
    for seed in range(60):
        draw = random.Random(seed)
        sizes = [draw.choice([1, 1, 2, 3, 9]) for _ in range(20)]
        places, widths, _ = s.runs(" ".join("w " * (n - 1) + f"w{k}." for k, n in enumerate(sizes)))
        spans = [(a, a + w) for a, w in zip(places.tolist(), widths.tolist())]
        for start in range(20):
            for end in range(start + s.RUN, 21):
                if sum(sizes[start:end]) >= s.MIN_WORDS:
                    within = [range(a, b) for a, b in spans if start <= a and b <= end]
                    assert set(range(start, end)) == set().union(*within)


def test_passages_that_begin_and_end_inside_sentences(docs):
    """Two whole sentences of 10 to 49 words, or one of 20, in a longer repeated passage."""
    def words(name, count):
        return " ".join(f"{name}{k}" for k in range(count))

    pair, short, one = (f"{words('p', 12)}. {words('q', 13)}.", f"{words('r', 3)}. {words('s', 7)}.",
                        f"{words('t', 20)}.")
    texts = []
    for whole in (pair, short, one):
        passage = f"{words('head', 20)}. {whole} {words('tail', 20)}"
        texts += [f"{words(f'a{len(texts) + i}x', 9)} {passage} {words(f'b{len(texts) + i}x', 9)}." for i in range(2)]
    rows = {r.doc_id: r for r in s.remove_repeats(docs(texts)).collect()}
    assert set(rows) == {1, 3, 5}
    for k, whole in ((1, pair), (3, short), (5, one)):
        assert whole in texts[k] and rows[k].text == texts[k].replace(f"{whole} ", "")
        assert rows[k].first_in == [k - 1]
