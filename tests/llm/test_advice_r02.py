
import numpy as np

from specgrade.llm.decontaminate import contaminated
from specgrade.llm.ngram_jaccard import ngram_components
from specgrade.llm.pii_spans import learn

from .test_exact_line_pack import table
from .test_text_models import _brute


def test_appended_copies_of_a_frequent_text(spark):
    """500 equal texts and copies with 10 to 17 % of words appended: the
    copies' prefixes hold their own words and few of the common text."""
    rng, rows = np.random.default_rng(8), []
    for g, n in enumerate((60, 120, 203, 400)):
        base = [f"g{g}w{i}" for i in rng.permutation(n)]
        rows += [(10_000 * (g + 1) + i, " ".join(base)) for i in range(500)]
        for i, share in enumerate((0.10, 0.13, 0.15, 0.16, 0.17)):
            rows.append((10_000 * (g + 1) + 600 + i, " ".join(base + [f"g{g}c{i}w{j}" for j in range(int(share * n))])))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_components(table(spark, rows)).collect())
    by_id = {d: c for d, _, c in got}
    want = {}
    for g in range(4):  # brute force over the distinct texts and one of the equal ones; the others follow it
        part = [r for r in rows if r[0] // 10_000 == g + 1]
        want |= {d: c for d, _, c in _brute([part[0], *part[500:]], 4, 85, 100)}
        want |= {str(d): str(part[0][0]) for d, _ in part[:500]}
    assert sum(c != d for d, c in want.items() if int(d) % 10_000 >= 600) >= 8
    wrong = {d: (by_id[d], c) for d, c in want.items() if by_id[d] != c}
    assert not wrong, wrong


def _found(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in contaminated(table(spark, list(enumerate(texts))), bench).collect()}


def test_one_text_gets_one_template(spark):
    short = "Which planet is the closest one to the Sun in our system"  # 12 words
    named = "Anna walked to the old market and bought fresh bread for her brother Paul who was waiting at home"
    long = "Rivers carry fine sand from the mountains down to the sea where it settles slowly on the flat bottom"
    reply = "Tom said that Anna bought 12\nkg of green apples at the old market of Paris last week"
    texts = [f"as we said in the lesson {short} and so on",  # verbatim, after a lower-case word
             f"we read, {' '.join(long.split()[:13])} and then nothing",  # a verbatim passage of 13 words
             named.replace(" ", "\n"), named.lower(), named.title(), named.upper(),  # re-wrapped, case changed
             "so,\n" + named.replace("Anna", "Maria").replace("Paul", "Hugo"),  # renamed, the first word too
             "so " + named.replace("Anna", "Maria").replace(" Paul", "\nHugo"),  # a name after a line break
             reply.replace("Anna", "Maria").replace("12\nkg", "9 kg"),  # a unit after a line break
             "which planet is far away", named.replace("market", "station").replace("bread", "milk").replace("Paul", "he")]
    got = _found(spark, [short, named, long, reply], texts)
    assert set(got) == {(0, 0), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 3)}
    assert got[0, 0].containment == 1.0 and got[1, 2].covered == 13
    assert [got[i, 1].reparameterised for i in range(2, 8)] == [False] * 4 + [True] * 2


def test_exact_passage_beside_a_clash_of_slots(spark):
    item = "the old farmer went to the market on every single morning of the week and Anna gave bread to Anna and then Anna went home with all of it"
    clash = item.replace("to Anna", "to Julia")
    got = _found(spark, [item], [f"we read {clash}"])
    assert set(got) == {(0, 0)} and not got[0, 0].reparameterised and got[0, 0].covered >= 13


def test_items_dense_in_slots(spark):
    items = ["Tom bought 3 pens for 5 dollars and 2 books for 4 dollars.", "What is 12 plus 7 times 3 minus 5 plus 8 times 4",
             "Add 3 and 4", "the sum of all of these 1 2 3 4 5 6 7 8 9 10"]
    other = ["Maria bought 9 pens for 8 euros and 6 books for 7 euros.", "What is 1 plus 2 times 3 minus 4 plus 5 times 6", "Add 5 and 6", "the sum of all of these 2 3 4 5 6 7 8 9 10 11"]
    clash = "Maria bought 9 pens for 8 euros and 6 books for 9 euros."  # 3 and 4 both become 9
    texts = [f"we read: {t} so there" for t in items + other + [clash]]
    got = _found(spark, items, texts)
    assert set(got) == {(i, i) for i in range(4)} | {(4, 0), (5, 1), (7, 3)}
    assert all(got[i, i].containment == 1.0 and not got[i, i].reparameterised for i in range(4))
    assert all(got[i + 4, i].containment == 1.0 and got[i + 4, i].reparameterised for i in (0, 1, 3))


def test_bounds_of_the_span_model_are_parameters(spark):
    texts = ["write to joe@example.com", "call +1 (939) 555-8456 now", "from 10.0.0.1 to 10.0.0.2", "card 4398874246221956", "a room of 12 by 30"]
    docs = table(spark, list(enumerate(texts)))
    usual, one, short = learn(docs), learn(docs, max_cases=1), learn(docs, max_chars=8)
    assert one.names == usual.names and not np.allclose(one.w, usual.w)
    assert set(short.names) < set(usual.names)
