import pytest

from lastleg.llm import line_dedup
from llm.conftest import words


def slow(docs, min_words):
    """Texts by (doc_id, text): a line goes if it lies in a run of min_words that occurred earlier."""
    keys = sorted(set(docs), key=lambda k: (k[0] is not None, k[0] or 0))
    lines = [(k, [(i, s.strip(" "), len(s.split())) for i, s in enumerate(k[1].split("\n")) if s.split()]) for k in keys if k[1] is not None]
    seen, gone = {}, {}
    for key, rows in lines:
        for a in range(len(rows)):
            total = 0
            for b in range(a, len(rows)):
                total += rows[b][2]
                run = tuple(r[1] for r in rows[a:b + 1])
                if total >= min_words:
                    if run in seen and seen[run] != (key, a):
                        gone.setdefault(key, set()).update(r[0] for r in rows[a:b + 1])
                    seen.setdefault(run, (key, a))
        for (i, *_), (j, *_) in zip(rows, rows[1:], strict=False):
            if {i, j} <= gone.get(key, set()):
                gone[key].update(range(i, j))
    return {k: k[1] if k not in gone else "\n".join(s for i, s in enumerate(k[1].split("\n")) if i not in gone[k]) for k in keys}


@pytest.mark.parametrize("min_words", [5, 12])
def test_equals_brute_force(spark, make_docs, min_words):
    import random
    rng = random.Random(min_words)
    pool = [words(rng.randint(1, 7), 100 * i) for i in range(9)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    got = {(r["doc_id"], r["before"]): r["text"] for r in _run(make_docs([(i, t, None, None) for i, t in docs]), min_words)}
    assert got == slow(docs, min_words)


def _run(df, min_words):
    from pyspark.sql import functions as F
    return line_dedup.dedup_lines(df.withColumn("before", F.col("text")), min_words).collect()


def test_minima_of_windows_are_selected_once(spark, make_docs):
    import random
    rng = random.Random(8)
    pool = [words(rng.randint(1, 6), 100 * i) for i in range(40)]
    docs = make_docs([(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 60))), None, None) for i in range(30)])
    lines = line_dedup.line_table(docs, 20).cache()
    by_doc, want = {}, set()
    for r in sorted(lines.collect(), key=lambda r: (r["d"], r["number"])):
        by_doc.setdefault(r["d"], []).append(r)
    for d, rows in by_doc.items():
        for i in range(len(rows)):
            ahead = [r for r in rows[i:] if r["before"] < rows[i]["before"] + 20]
            if ahead[-1]["upto"] - ahead[0]["before"] >= 20:
                least = min(ahead, key=lambda r: (r["h"], r["number"]))
                want.add((d, least["number"], least["h"]))
    got = [(r["d"], r["number"], r["fp"]) for r in line_dedup.selected(lines).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(got) < 0.5 * lines.count()
    lines.unpersist()


def test_tail_of_a_run_follows_the_occurrence_that_goes_on(make_docs):
    """The first copy of the run's windows ends early; a later copy goes on, and so does the third."""
    run, tail = "\n".join(words(10, 10 * i) for i in range(5)), words(7, 900)
    text = {r["doc_id"]: r["text"] for r in _run(make_docs([
        (1, f"{run}\nown end", None, None), (2, f"{words(3, 800)}\n{run}\n{tail}", None, None), (3, f"{run}\n{tail}\nlast", None, None),
    ]), 50)}
    assert text[2] == f"{words(3, 800)}\n{tail}" and text[3] == "last"


def test_long_passages_go_and_short_lines_stay(make_docs):
    passage = words(55)
    rows = _run(make_docs([
        (1, f"first own line\n{passage}\nlast", None, None), (2, f"And the.\n{words(30)}\n{words(25, 30)}\nAnd the.", None, None),
        (3, f"And the.\n{passage}", None, None), (4, f"x\n{words(30)}\n\n{words(25, 30)}\ny", None, None),
    ]), 50)
    text = {r["doc_id"]: r["text"] for r in rows}
    assert text[1].startswith("first own line") and passage in text[1]
    assert text[2].count("w") > 50 and text[3] == "And the."
    assert text[4] == "x\ny"
    assert [tuple(s) for s in next(r for r in rows if r["doc_id"] == 4)["removed_spans"]] == [(1, 3)]


def test_odd_documents(odd_docs, no_docs):
    done = line_dedup.dedup_lines(odd_docs)
    assert sorted(done.columns) == sorted(odd_docs.columns)
    rows = done.collect()
    assert len(rows) == odd_docs.count()
    text = {r["doc_id"]: r["text"] for r in rows}
    assert text[2] == "" and text[9] == "" and len(text[8]) > 1000 and text[4] is None and text[5] == ""
    assert line_dedup.dedup_lines(no_docs).count() == 0
