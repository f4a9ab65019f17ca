import random
import re
from collections import Counter

import pytest

from lodestar.llm import decontamination as dc
from lodestar.llm import queries

from .tables import odd, prose, table

NAME = re.compile(r"(?<![^\W_])([A-ZÀ-Þ][a-zà-ÿ]+)(?![^\W_])")


def tokens(text):
    """(placeholder or word, value) of each template word."""
    t = NAME.sub(lambda m: f"⟦a{m[1]}⟧", text.replace("⟦", " ").replace("⟧", " ")).lower().replace("⟧ ⟦a", dc.JOINT).replace("ß", "ss")
    t = "".join(x if x.startswith("⟦") else re.sub(r"(?<![^\W_])(" + "|".join(dc.NUMBERS) + r")(?![^\W_])", lambda m: str(dc.NUMBERS[m[1]]), x) for x in re.split("(⟦[^⟧]*⟧)", t))
    t = re.sub(r"[.,:/](?![0-9])|(?<![0-9])[.,:/]", " ", t)
    t = re.sub(r"(?:[^\w⟦⟧.,:/]|_)+", " ", t)
    t = re.sub(r"([0-9][0-9.,:/]*)", r" ⟦n\1⟧ ", t)
    out = []
    for w in t.split():
        if out and out[-1][0] == "⟦n⟧" and w in dc.UNITS:
            out.append(("⟦u⟧", "u" + w))
        elif m := re.fullmatch(r"⟦([an])(.*)⟧", w):
            out.append((f"⟦{m[1]}⟧", m[1] + m[2]))
        else:
            out.append((w, None))
    return out


def shingled(text):
    t = tokens(text or "")
    return [tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))] if t else []


def brute(docs, items):
    """Occurrence by occurrence, in plain loops."""
    bare, vals = (lambda w: tuple(x for x, _ in w)), (lambda w: tuple(v for _, v in w if v is not None))
    weak = lambda w: len(w) - len(vals(w)) < min(3, len(w))
    meets = lambda w, x: w == x if weak(w) else bare(w) == bare(x)
    texts, out = {}, {}
    for d, text in docs:
        texts.setdefault(d, set()).add(text)
    own = {}
    for i, item in {((i, form), t) for i, x in items for form, t in enumerate([x, (x or "").lower()]) if form == 0 or t != x}:
        first = {}
        for at, w in enumerate(shingled(item)):
            first.setdefault(w, at)
        strong = {w: at for w, at in first.items() if not weak(w)}
        own[i] = strong if 2 * len(strong) > len(first) else first
    for d, versions in texts.items():
        spots = {}
        for text in versions:
            for pos, w in enumerate(shingled(text)):
                spots.setdefault(bare(w), set()).add((pos, w))
        for i, windows in own.items():
            n = len(windows)
            met = sorted((pos - at, at, pos, w, x) for w, at in windows.items() for pos, x in spots.get(bare(w), ()) if meets(w, x))
            runs, last = [], None
            for m in met:
                if last is None or m[0] - last > min(max(5, n // 4), n + 3):
                    runs.append([])
                runs[-1].append(m)
                last = m[0]
            for run in runs:
                weight, votes = Counter(m[0] for m in met), {}
                for diagonal, _, _, w, x in run:
                    for f, t in zip(vals(w), vals(x)):
                        votes.setdefault(f, Counter())[t] += weight[diagonal]
                stands = {f: min(c, key=lambda t: (-c[t], t)) for f, c in votes.items()}
                found = {at for _, at, _, w, x in run if all(stands[f] == t for f, t in zip(vals(w), vals(x)))}
                if len(found) >= 0.8 * n:
                    same = all(any(vals(w) == vals(x) for _, a, _, w, x in run if a == at) for at in {m[1] for m in run})
                    out[d, i[0]] = max(out.get((d, i[0]), (0, 0, 0, 0)), (len(found) / n, same, len(found), n))
    return {k: (f, n, "verbatim" if same else "re-parameterised") for k, (_, same, f, n) in out.items()}


ITEM = "A train leaves the town of Orden at 9:30 and travels 120 km to the city of Maren. After a stop of 15 minutes Orden calls the train back. How far has the train gone by then, if 120 km take it 2 hours?"


def test_reparameterised_questions_are_caught(spark):
    other = ITEM.replace("Orden", "Silva").replace("Maren", "Tolka").replace("120", "95.5").replace("9:30", "7:05").replace("15", "25").replace("km", "miles").replace(" 2 ", " 3 ")
    loose = ITEM.replace("120 km take", "77 miles take").replace("Orden calls", "Pavel calls")
    texts = ["Before it. " + ITEM + " After it.", prose(1, 50) + " " + other + " " + prose(2, 50), ITEM.upper().replace(":", "; "), prose(3, 200), other[:90] + prose(4, 30), "so " + ITEM.replace(" ", "\n"), loose]
    items = [(0, ITEM), (1, "Short one here"), (2, None), (3, "")]
    found = dc.matches(table(spark, [*texts, "Short one, here!", "a Short one here now"]), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.kind for r in found}
    assert got[0, 0] == "verbatim" and got[1, 0] == "re-parameterised" and (3, 0) not in got and (4, 0) not in got
    assert (7, 1) in got and (8, 1) not in got and not any(i in (2, 3) for _, i in got)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_equals_brute_force(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(dc, "MOST_BROADCAST", most)
    rng = random.Random(8)
    items = []
    for i in range(12):
        w = prose(i, 30).split()
        for k in range(0, 30, 6):
            w[k + rng.randrange(5)] = rng.choice(["12", "3.5 kg", "Nora", "40", "7 km,", "Ivan"])
        items.append((i, " ".join(w)))
    docs = []
    for i, text in items:
        for n in range(4):
            t = text
            for a, b in (("12", "77"), ("Nora", "Edda"), ("40", rng.choice(["40", "41"])), ("kg", "g"))[: rng.randrange(5)]:
                t = t.replace(a, b, rng.choice([1, 9]))
            w = t.split()
            if n == 3:
                del w[rng.randrange(len(w))]
            docs.append((len(docs), prose(50 + len(docs), 20) + " " + " ".join(w) + ". " + prose(90 + len(docs), 20)))
    docs += [(len(docs), None), (len(docs) + 1, ""), (0, docs[0][1]), (len(docs) + 2, "12 40 Nora")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.found, r.windows, r.kind) for r in queries.op4_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert got == brute(docs, items) and len(got) > 20


def test_items_are_found_whatever_their_case(spark):
    folder = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = [(r.item_id, r.text) for r in items.collect()]
    docs = [(3 * i + k, f"{prose(i, 40)} {f(t)} {prose(i + 100, 40)}") for i, t in rows for k, f in enumerate((str, str.lower, str.upper))]
    docs += [(1000 + d, prose(2000 + d, 80)) for d in range(40)]
    got = {(r.doc_id, r.item_id): r.kind for r in dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(3 * i + k, i): "verbatim" for i, _ in rows for k in range(3)}


def test_names_of_several_words_and_numbers_in_words(spark):
    item = "On the way to the market Alice meets Bob, who carries 3 bags of flour. If Bob sells 2 of the bags to Alice for 60 dollars each, how much money has he got for the bags, and how many miles are 60 miles?"
    other = item.replace("Alice", "Mary Ann").replace("Bob", "Jean Luc Pavel")
    docs = [f"{prose(1, 30)}. {x} {prose(2, 30)}" for x in (other, item.replace("3 bags", "three bags").replace("2 of", "two of"), item.replace("3 bags", "seven bags"), item.replace("60 miles?", "60 km?"), item)]
    docs += ["Three men and Two women. " + prose(3, 60)]
    got = {r.doc_id: r.kind for r in dc.matches(table(spark, docs), spark.createDataFrame([(0, item)], "item_id long, text string")).collect()}
    assert got == {0: "re-parameterised", 1: "verbatim", 2: "re-parameterised", 3: "re-parameterised", 4: "verbatim"}


def test_windows_begin_at_words_and_numbers_are_told_by_one_search(spark):
    """Letters of two UTF-16 units begin no window in their middle; texts with and without numbers have the templates of the plain loops."""
    texts = ["\U0001d41a said that \U0001d41abc was b\U0001d41b here too", "a b c d", "a b c d e", "", "twenty-three two.five 3.two often ten, Three 12.5 km 9:30 5km two", "ten men", "men of ten", "Often tenants attend", "x_two\n-three- ½ two² McTwo Bob Three", "1,000 :4 3: ..5.. 1/2 1./3 kg"]
    got = {}
    for r in dc.windows(table(spark, texts), "doc_id").where("window is not null").collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.window
    for i, text in enumerate(texts):
        full = [" ".join(w if v is None else f"⟦{v}⟧" for w, v in x) for x in shingled(text)]
        assert [got.get(i, {}).get(k) for k in range(len(full))] == full and len(got.get(i, {})) == len(full), text


STORIES = (
    "Alice buys 3 apples. Alice eats 2 apples. How many apples has Alice left?",
    "{a} walks {n} km to the market. On the way {a} meets {b}, who carries {m} kg of flour and {k} eggs. If {b} sells all the eggs, how many kg does {b} still carry?",
    "A box holds {n} red marbles and {m} blue marbles. {a} takes {k} marbles without looking. How likely is it that all the marbles {a} has taken are red?",
    "{a} earns {n} dollars a day. After {m} days {a} gives {k} dollars to {b}. {b} spends half of it. How much money do {a} and {b} have together now?",
    "The bus to {a} leaves every {n} minutes from the square. {b} arrives {m} minutes after a bus has left, and waits {k} minutes. Was the bus late that day?",
)


def story(t, rng):
    a, b = rng.sample(["Alice", "Robert", "Nora", "Ivan", "Edda", "Pavel"], 2)
    n, m, k = (str(rng.randrange(2, 99)) + rng.choice(["", ".5"]) for _ in range(3))
    if t is STORIES[0]:
        return t.replace("Alice", a).replace("3", n).replace("2", m)
    return t.replace("{a}", a).replace("{b}", b).replace("{n}", n).replace("{m}", m).replace("{k}", k).replace(" km ", rng.choice([" km ", " miles "])).replace(" kg ", rng.choice([" kg ", " pounds "]))


def test_variants_are_found_one_or_two_a_document(spark):
    rng = random.Random(12)
    items = [(i, story(t, rng)) for i, t in enumerate(STORIES)]
    docs, holds = [], {}
    for d in range(160):
        i, many = d % 5, 1 + d // 5 % 2
        said = [story(STORIES[i], rng) for _ in range(many)]
        holds[d] = i
        docs.append((d, prose(d, 30) + ". " + rng.choice([" ", " " + prose(d + 500, 40) + ". "]).join(said) + " " + prose(d + 900, 30)))
    docs += [(1000 + d, " ".join(prose(2000 + d, 80).capitalize().split())) for d in range(60)]
    got = {(r.doc_id, r.item_id) for r in dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= set(holds.items()) and len(got) >= 0.95 * len(holds)


def test_items_of_numbers_and_repeated_templates(spark):
    items = [(0, "12 34 56 78 90 11 23"), (1, "What is 12 * 15 + 30 / 4?"), (2, "Ann has 3 old cats. Bob has 4 old cats. Cid has 5 old cats. Dan has 6 old cats. Who has most?")]
    docs = [f"{prose(1, 20)} {items[0][1]} {prose(2, 20)}", f"{prose(3, 20)} {items[1][1]} {prose(4, 20)}", items[2][1], items[2][1].replace("Bob", "Eve").replace("6", "9"), "12 34 56 78 90 11 24 9 8 7 6 5", "What is 13 * 16 + 31 / 5?", "Ann has 3 old cats. " + prose(5, 30)]
    got = {(r.doc_id, r.item_id): r.kind for r in dc.matches(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 0): "verbatim", (1, 1): "verbatim", (2, 2): "verbatim", (3, 2): "re-parameterised"}
    assert {k: v[2] for k, v in brute(list(enumerate(docs)), items).items()} == got


def test_odd_rows(spark):
    docs = odd(spark)
    items = spark.createDataFrame([(1, prose(2, 60), "x"), (None, prose(2, 60), "x"), (3, None, "y"), (1, prose(2, 60), "x")], "item_id long, text string, doc_id string")
    got = dc.matches(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id, r.coverage) for r in got), key=str) == sorted([(7, 1, 1.0), (7, None, 1.0), (8, 1, 1.0), (8, None, 1.0)], key=str)
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 6, 9, None]
    assert dc.matches(odd(spark, []), items).count() == 0 and dc.matches(docs, items.limit(0)).count() == 0
    assert dc.clean(docs, items.limit(0)).count() == docs.count()
