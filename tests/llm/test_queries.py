"""All queries on the smallest tables: against SQL where there is some, else against plain restatements."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.test_oracles import _rows
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "labels", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    assert _rows(QUERIES[name](spark, sf_dir).toPandas()) == _rows(duck.execute(ORACLES[name]).fetchdf())


def test_op1(spark, sf_dir, docs):
    found = QUERIES["op1_sharding"](spark, sf_dir).toPandas()
    assert sorted(found.doc_id) == sorted(d for d, _ in docs)
    text = dict(docs)
    assert list(found["size"]) == [len(text[d].encode()) + 1 for d in found.doc_id]
    assert list(found.text_crc32) == [zlib.crc32(text[d].encode()) for d in found.doc_id]
    assert set(found.shard) == set(range(8)) and set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    for _, shard in found.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    sizes = found.groupby("shard")["size"].sum()
    assert sizes.max() < 1.05 * sizes.mean()
    assert (found.assign(text=found.doc_id.map(text)).groupby("text").shard.nunique() == 1).all()


def test_op2_held_out(spark, sf_dir, duck):
    large = sf_dir.replace("0.001", "0.01")
    found = QUERIES["op2_toxicity"](spark, large).toPandas()
    labels = duckdb.execute(f"SELECT doc_id, toxic FROM '{large}/labels.parquet'").fetchdf()
    assert ((found.score >= 0) & (found.score <= 1)).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in found.doc_id]).all()
    unseen = found[found.held_out].merge(labels, on="doc_id")
    toxic = unseen[unseen.toxic == 1]
    assert toxic.predicted.mean() >= 0.8 and unseen[unseen.toxic == 0].predicted.mean() <= 0.02


def test_op5_base(spark, sf_dir, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = QUERIES["op5_secrets"](spark, sf_dir).toPandas().set_index("doc_id")
    for doc_id, text in docs:
        base = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(base))
        row = found.loc[doc_id]
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(b[1] == k for b in base) for k in range(3)]
        assert set(joined.split(",")) <= set(row.spans.split(","))


def test_op7(spark, sf_dir, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = QUERIES["op7_packing"](spark, sf_dir).toPandas()
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        at = 0
        for piece in found[found.doc_id == doc_id].sort_values("start").itertuples():
            part = ids[at : at + piece.length]
            assert piece.start == at and piece.doc_tokens == len(ids)
            assert piece.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += piece.length
        assert at == len(ids)
    full = 0
    for _, sequence in found.groupby("sequence_id"):
        at = 0
        for piece in sequence.sort_values("offset").itertuples():
            assert piece.offset == at
            at += piece.length
        assert at <= 4096 and len(sequence) <= 128
        full += 4096
    assert found.length.sum() > 0.9 * full


def test_op9(spark, sf_dir, docs):
    found = QUERIES["op9_lm_scoring"](spark, sf_dir).toPandas().set_index("doc_id")
    tokens = {d: [*t.encode().lower().split(), b""] for d, t in docs}
    trained = [(d, t.encode()) for d, t in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    count = Counter(w for d, _ in trained for w in tokens[d])
    n, v = count.total(), len(count)
    contexts = [defaultdict(Counter) for _ in range(5)]
    for _, t in trained:
        padded = b"\0" * 4 + t
        for i in range(4, len(padded)):
            for k in range(5):
                contexts[k][padded[i - k : i]][padded[i]] += 1

    def cost(padded, i):
        total, gone = 0.0, set()
        for k in range(4, -1, -1):
            left = {s: c for s, c in contexts[k][padded[i - k : i]].items() if s not in gone}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if padded[i] in left:
                return total + math.log10(left[padded[i]] / whole)
            total += math.log10(len(left) / whole)
            gone |= left.keys()
        return total - math.log10(256 - len(gone))

    for doc_id, text in docs:
        row = found.loc[doc_id]
        assert row.train_tokens == n and row.n_tokens == len(tokens[doc_id]) and row.n_known == sum(w in count for w in tokens[doc_id])
        assert row.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[doc_id]), rel=1e-9)
    for doc_id, text in docs[:40]:
        padded = b"\0" * 4 + text.encode()
        assert found.loc[doc_id].score == pytest.approx(sum(cost(padded, i) for i in range(4, len(padded))), rel=1e-9)


def test_op10(spark, sf_dir, docs):
    found = QUERIES["op10_sentencepiece"](spark, sf_dir).toPandas()
    assert len(found) == len(docs) and found.round_trip.all()


def test_op10_takes_the_best_cut(spark, docs):
    """Against a search over all cuts, with the real vocabulary."""
    import random

    import sentencepiece

    from tests.llm.conftest import frame
    from tidemark.llm import pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    score = {model.id_to_piece(i): model.get_score(i) for i in plain}
    longest, unknown = max(map(len, score)), min(score.values()) - pieces.RESERVE
    rng = random.Random(3)
    odd = ["".join(rng.choice("aeinrstdlu  .,\n\t\x00é日本\U0001f600▁_1Z") for _ in range(80)) for _ in range(60)]
    texts = dict(enumerate([*(t[:250] for _, t in docs[:60]), *odd, "", " ", "  a"]))

    def best(text):
        ways = [0.0]
        for end in range(1, len(text) + 1):
            found = [ways[start] + score[text[start:end]] for start in range(max(0, end - longest), end) if text[start:end] in score]
            ways.append(max([*found, *([] if text[end - 1] in score else [ways[-1] + unknown])]))
        return ways[-1]

    for row in pieces.encode(frame(spark, texts.items()), path).collect():
        total, left = 0.0, 0
        for i in row["ids"]:
            if not model.is_byte(i):
                total += model.get_score(i)
            elif left:
                left -= 1
            else:  # the first byte of a character spelled out
                lead = int(model.id_to_piece(i)[3:5], 16)
                left = 0 if lead < 0x80 else 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3
                total += unknown
        assert total == pytest.approx(best(pieces.marked(texts[row["doc_id"]])), abs=1e-2)
