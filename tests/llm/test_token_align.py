"""Token alignment against the two libraries and a plain loop over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from colophon.llm import token_align
from tests.llm.conftest import prose

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHAPE = "doc_id long, text string, a string, pair long, `a.b` string, id string, n long"
ODD = ["", None, " ", "  two  spaces  ", "\n", "a\n\n  b\tc \n", "<s> x </s> <|endoftext|> [INST]", "naïve Śiva 漢字 🙂 é", "▁ under", "x" * 5000, " nbsp em", "0x0A <0x0A>", "\x00\x01", "don't we'll I'VE 12345 ...!!!"]


@pytest.fixture(scope="module")
def rows():
    out = [(k, prose(k % 17, 5 + 11 * k % 90) + (".\n" if k % 3 else "")) for k in range(60)] + [(100 + k, t) for k, t in enumerate(ODD)]
    out += [(200, prose(7, 20_000)), (3, "again three"), (None, "no id"), (None, "no id")]
    return [(*r, "a", 1, "x", "y", 2) for r in out]


def plain(texts):
    from tokenizers import Tokenizer
    import sentencepiece

    a, b = Tokenizer.from_file(public_tokenizers.path(A)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    a.encode_special_tokens = True
    letters = token_align.byte_letters()
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, links = [], []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        raw = (" " + t).encode() if t else b""
        if b"".join(map(bytes_a, ids_a)) != raw or b"".join(map(bytes_b, ids_b)) != raw or not t:
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(bytes_a(i)) for i in ids_a]), np.cumsum([len(bytes_b(i)) for i in ids_b])
        cuts, groups, i, j = sorted(set(ends_a.tolist()) & set(ends_b.tolist())), [], 0, 0
        pairs = []
        for c in cuts:
            ga, gb, i0, j0 = [], [], i, j
            while i < len(ids_a) and ends_a[i] <= c:
                ga.append(ids_a[i])
                i += 1
            while j < len(ids_b) and ends_b[j] <= c:
                gb.append(ids_b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            for p in range(i0, i):
                for q in range(j0, j):
                    if max(ends_a[p - 1] if p else 0, ends_b[q - 1] if q else 0) < min(ends_a[p], ends_b[q]):
                        pairs.append((ids_a[p], ids_b[q]))
        out.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(pairs)
    count = Counter(p for x in links for p in x)
    top = defaultdict(int)
    for (_, q), n in count.items():
        top[q] = max(top[q], n)
    return [(*o[:3], len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), o[3]) for o, x in zip(out, links)]


@pytest.mark.parametrize("hot", [token_align.HOT, 50, 0])
def test_against_plain_loop(spark, rows, hot):
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    got = token_align.aligned(df, public_tokenizers.path(A), public_tokenizers.path(B), hot=hot)
    assert Counter(tuple(r)[:8] for r in got.collect()) == Counter((r[0], *w) for r, w in zip(rows, plain([r[1] for r in rows])))


def test_cut_texts_give_the_ids_of_whole_texts(rows):
    pieces = token_align.Pieces(public_tokenizers.path(B))
    assert pieces.cuts
    texts = [r[1] for r in rows if r[1]] * 2
    assert [x.tolist() for x in pieces.encode(texts)] == pieces.model.encode(texts)
    pieces.cuts = False
    assert [x.tolist() for x in pieces.encode(texts)] == pieces.model.encode(texts)


def test_both_libraries_read_a_byte_level_file_alike(rows, tmp_path):
    import json

    path = public_tokenizers.path(A)
    plain_file, other = token_align.ByteLevel(path), tmp_path / "other.json"
    spec = json.loads(open(path, encoding="utf-8").read())
    spec["model"]["merges"] = spec["model"]["merges"][:1000]  # no longer a merge per id: read by the tokenizers library
    other.write_text(json.dumps(spec))
    from tokenizers import Tokenizer

    for vocabulary, file in ((plain_file, path), (token_align.ByteLevel(str(other)), str(other))):
        library = Tokenizer.from_file(file)
        library.encode_special_tokens = True
        for r in rows:
            if r[1]:
                assert vocabulary.encode([r[1]])[0].tolist() == library.encode(" " + r[1], add_special_tokens=False).ids


def test_empty_table(spark):
    none = spark.createDataFrame([], SHAPE)
    assert token_align.aligned(none, public_tokenizers.path(A), public_tokenizers.path(B)).count() == 0
