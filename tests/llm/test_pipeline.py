import collections
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowlake.llm import language_id, mixing, ngram_join

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, room int, rounds int, edge int, h string, s string, c0 int, _lang string, _keep int, fp long, `a.b` string"
WORDS = {
    "en": "the of and to in is was for with that from this have not are been were which their would".split(),
    "de": "der die das und ist nicht ein eine mit für auf von zu sich über werden durch wurde".split(),
}


def rows():
    rng = random.Random(11)
    out = []
    for i in range(260):
        lang = rng.choice(["en", "de"])
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(40, 300))), lang, rng.choice(["a", "a", "b", "c", None])))
    for i in range(40):  # near copies of some
        w = out[i % 7][1].split()
        w[rng.randrange(len(w))] = "changed"
        out.append((1000 + i, " ".join(w), out[i % 7][2], rng.choice(["a", "b"])))
    out += [out[3], out[3], (None, "the of and to in is was for", "en", "a"), (2000, None, "en", "a"), (2001, "", None, "b"), (2002, "12 !!", "de", "c"), (2003, "漢字" * 50, None, "c"),
            (2004, "the which would " * 9000, None, "c"), (2005, "the end <|endoftext|> of which", "en", "c")]
    return [(*r, len(r[1]) if r[1] is not None else None, 1, 2, 3, "h", "s", 4, "q", 5, 6, "dot") for r in out]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def one_of_each(docs):
    """Brute force: the row of the smallest doc_id of each component, rows without a doc_id last."""
    sets = [shingles(d[1]) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, d in enumerate(docs):
        groups[find(i)].append(d)
    return sorted(str(min(g, key=lambda d: (d[0] is None, d[0] or 0))[:2]) for g in groups.values())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage and the result of the last."""
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows(), COLUMNS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return str(folder), [*out, docs]


def test_stages_keep_the_columns(stages):
    _, (docs, *more, packed) = stages
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "mixing", "packing"]
    for df in more:
        assert df.dtypes == docs.dtypes
        assert {tuple(r)[5:] for r in df.collect()} == {(1, 2, 3, "h", "s", 4, "q", 5, 6, "dot")}
    assert "sequence_id" in packed.columns


def test_language_stage(stages):
    before, after = (collections.Counter(map(tuple, df.collect())) for df in stages[1][:2])
    gone = {r[0] for r in before if not any(r[:2] == x[:2] for x in after)}
    assert gone == {2000, 2001, 2002, 2003}
    assert sum(before.values()) - sum(after.values()) == 4 and {r[2] for r in after} == {"en", "de"}


def test_join_stage(stages):
    docs = [tuple(r) for r in stages[1][1].collect()]
    assert sorted(str(tuple(r)[:2]) for r in stages[1][2].collect()) == one_of_each(docs)


def test_mixing_stage(stages):
    docs, mixed = ([tuple(r) for r in df.collect()] for df in stages[1][2:4])
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    times = collections.Counter(mixed)
    assert set(times) <= set(docs) and max(times.values()) <= 2
    have, got, most = collections.Counter(), collections.Counter(), collections.Counter()
    for r in docs:
        have[r[3]] += size(r)
        most[r[3]] = max(most[r[3]], size(r))
    for r in mixed:
        got[r[3]] += size(r)
    weights = dict(zip([*sorted(x for x in have if x is not None), *([None] if None in have else [])], [5, 2, 1] * 3))
    goal, open_, left = {}, set(have), 1.5 * sum(have.values())
    while over := [s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) > 2 * have[s]]:
        for s in over:
            goal[s] = 2 * have[s]
        left = 1.5 * sum(have.values()) - sum(goal.values())
        open_ -= set(over)
    goal |= {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
    for s in have:
        assert abs(got[s] - goal[s]) <= most[s] / 2 + 1


def test_packing_stage(stages):
    docs, pieces = stages[1][3].collect(), stages[1][4].collect()
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = collections.Counter()
    for r in docs:
        want[r["doc_id"]] += len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert got == want


def test_run_gives_what_its_stages_give(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32"]
    packed = collections.Counter(tuple(r[c] for c in ("doc_id", "doc_tokens")) for r in stages[1][-1].where("start = 0").collect())
    ran = corpus_pipeline.run(spark, stages[0])
    assert set(key) <= set(ran.columns)
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "doc_tokens")) for r in ran.where("start = 0").collect()) == packed


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


@pytest.mark.parametrize("stage", [language_id.keep_known, ngram_join.one_per_component, mixing.mixed_rows])
def test_null_columns(spark, stage):
    df = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, lang string, source string")
    assert {tuple(r) for r in stage(df).collect()} <= {(None,) * 4}
