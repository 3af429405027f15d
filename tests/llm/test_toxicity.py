import random
import zlib

import pyarrow.parquet as pq

from photonframe.llm import toxicity as tx

VOCAB = ["house", "river", "cloud", "garden", "walks", "green", "table", "seven", "paper", "window"]


def made(rng, toxic):
    words = [rng.choice(VOCAB) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(8, 40))]
    if toxic:
        for _ in range(rng.randint(1, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(["grumbo" + rng.choice(["x", "la", "ti", "zu", "ko"]), "flork"]))
    return " ".join(w + (". " if rng.random() < 0.15 else "") for w in words)


def in_turn(symbols):
    for p in tx.forward_parts():
        symbols = p.run(symbols)
    symbols = symbols[::-1]
    for p in tx.backward_parts():
        symbols = p.run(symbols)
    return symbols[::-1]


def test_composition_equals_running_in_turn():
    rng = random.Random(1)
    whole = tx.Grammar()
    for _ in range(2000):
        text = "".join(rng.choice(tx.INPUT) for _ in range(rng.randint(0, 12)))
        assert whole.run(text) == in_turn(text)


CASES = {
    "insult": ["The idiot left.", "A GRUZAK came", "the stupid machine broke"],
    "targeted": ["you are an idiot", "idiot, you are", "you idiot", "Idiots like the idiot beside you", "do not come here, you idiot", "never mind you idiot"],
    "negated": ["he is not an idiot", "isn't he an idiot", "never call him an idiot", "no idiot here", "he is no idiot"],
    "reported": ["she said idiot", "she said he is an idiot", "you are an idiot, he said", "he said: you idiot", "they called him an idiot"],
    "aimed": ["they will kill it", "I will kill you", "you will be killed", "we are strangling them", "ich werde dich töten", "voy a matar a ustedes"],
    "threat": ["kill time", "he killed the engine", "a killing frost"],
}


def test_grammar_kinds():
    model = tx.Model({"idiot", "stupid"}, {4: {"gruz"}})
    kinds = lambda text: {k for k, n in zip(tx.KINDS, model.counts(text)) if n}
    for kind, texts in CASES.items():
        for text in texts:
            assert kinds(text) == {kind}, text
    assert kinds("you will not be killed") == kinds("he said he will kill you") == kinds("nothing here, you") == set() and model.counts(None) == model.counts("") == [0] * (len(tx.KINDS) + 1)
    assert tx.Model(set(), {}, {4: {"gruz"}}).counts("gruzx, gruzy gruzx. A gruza | b")[-2:] == [2, 6]


def test_the_trained_model_follows_the_grammar(spark, sf_dir):
    """Weights learned on the table keep what the grammar says of each kind."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = tx.train(docs, labels)
    score = lambda text: model.score(model.counts(text))
    assert score("you idiot") >= score("idiot") >= 0.5 and score("idiot, you are") >= score("idiot")
    assert all(score(t) >= 0.5 for t in CASES["aimed"])
    assert all(score(t.replace("gruzak", "idiot")) < 0.5 for kind in ("negated", "reported", "threat") for t in CASES[kind])
    for _, w in zip(tx.KINDS, model.weights[1:], strict=False):
        assert w >= 0
    # Labels that call every targeted insult clean cannot turn the grammar around.
    w = tx.fit([(0, tx.evidence([0, 1, 0, 0, 0, 0, 0, 8]), 500), (1, tx.evidence([1, 0, 0, 0, 0, 0, 0, 8]), 500)], tx.Model(set(), {}).weights)
    assert w[2] == 0


def test_learns_unseen_endings_and_keeps_clean(spark):
    rng = random.Random(2)
    rows = [(i, made(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(3, None, 1), (None, 1, 1), (9999, 1, 1)], "doc_id long, toxic int, quality int")
    model = tx.train(df, labels.filter("doc_id < 400 or doc_id is null or doc_id > 5000"))
    extra = spark.createDataFrame([(700, "a grumbonew day"), (701, None), (702, ""), (702, ""), (703, "garden " * 40000), (704, " | , ")], "doc_id long, text string")
    got = {r.doc_id: r for r in tx.score(df.select("doc_id", "text").unionAll(extra), model, ["doc_id"]).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if i >= 400]
    assert all(p == y for p, y in held)
    assert got[700].predicted == 1 and not any(got[i].predicted for i in (701, 702, 703, 704))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_scores_by_plain_version(spark):
    """Every score again, clause by clause, transducer by transducer, without the composed machine; nothing is cut off."""
    rng = random.Random(3)
    model = tx.Model({"flork"}, {5: {"grumb"}}, {4: {"hous"}})
    vocab = [*VOCAB, "flork", "grumbola", "you", "not", "said", "kill", "will", "houses", "."]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["flork. " * 5000, "you flork! " * 300, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tx.score(df, model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        kinds, words = dict.fromkeys(tx.KINDS, 0), 0
        for clause in (text or "").split("."):
            for piece in clause.split("!"):
                names = piece.split()
                words += len(names)
                symbols = "".join({"flork": "I", "grumbola": "I", "you": "G", "not": "N", "said": "R", "kill": "T", "will": "M", "house": "W", "houses": "W"}.get(w, "o") for w in names)
                for kind in {tx.OUTPUT[s] for s in in_turn(symbols) if s in tx.OUTPUT}:
                    kinds[kind] += 1
        seen = kinds | {"targeted": kinds["targeted"] + kinds["aimed"], "insult": kinds["insult"] + kinds["targeted"] + kinds["aimed"]}
        z = model.weights[0] + sum(w * n / (n + 1) for w, n in zip(model.weights[1:], seen.values())) + model.weights[-1] * kinds["doubtful"] / (words / 8 + 2)
        assert got[i].clauses == sum(kinds.values()) and abs(got[i].score - 1 / (1 + 2.718281828459045 ** -max(-50, min(50, z)))) < 1e-9
    assert got[200].clauses == 5000


def test_kept_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", 2.0, "you flork")], "`a.b` long, predicted string, score double, text string")
    got = tx.score(df, tx.Model({"flork"}, {}), ["a.b", "predicted", "score"])
    assert got.columns == ["a.b", "score", "predicted", "clauses"] and got.collect()[0][0] == 1


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    model = tx.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.doc_id: r.predicted for r in tx.score(df, model, ["doc_id"]).collect()} == {1: 1, 2: 0}
    assert tx.score(df.limit(0), model, ["doc_id"]).count() == 0


def test_query_on_its_table(spark, sf_dir):
    from photonframe.llm.queries import QUERIES

    toxic = {d["doc_id"]: d["toxic"] for d in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    got = QUERIES["op2_toxicity"](spark, sf_dir).collect()
    assert len(got) == pq.read_metadata(f"{sf_dir}/documents.parquet").num_rows
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.85 * len(held)
