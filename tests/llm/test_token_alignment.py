"""op13 against the libraries on whole texts and a plain count, and on odd tables."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrel.llm import token_alignment
from kestrel.llm.packing import _byte_of_char
from kestrel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(texts):
    """Per text the contract's numbers, from the two libraries and byte ranges."""
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = _byte_of_char()
    docs = []
    for text in texts:
        text = text or ""
        a = [(i, bytes(byte[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode())
             for i in b_lib.encode(text) for p in [b_lib.id_to_piece(i)]]
        raw = (" " + text).encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a = b = []
        links, groups, i, j, at_a, at_b, group = [], [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                group[0].append(a[i][0])
                at_a, i = at_a + len(a[i][1]), i + 1
            else:
                group[1].append(b[j][0])
                at_b, j = at_b + len(b[j][1]), j + 1
            if at_a == at_b:
                groups.append(group)
                group = ([], [])
        at = 0
        spans_b, first = [], 0
        for i, x in b:
            spans_b.append((at, at + len(x), i))
            at += len(x)
        at = 0
        for i, x in a:
            while first < len(spans_b) and spans_b[first][1] <= at:
                first += 1
            for lo, hi, k in spans_b[first:]:
                if lo >= at + len(x):
                    break
                links.append((i, k))
            at += len(x)
        docs.append((len(a), len(b), groups, links))
    held = Counter(p for *_, links in docs for p in set(links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for n_a, n_b, groups, links in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(shown.encode()).hexdigest() if n_a else ""))
    return out


def test_equals_the_libraries_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows])))
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in QUERIES["op13_token_alignment"](spark, SF).collect()}
    assert got == want


ODD = [None, "", "the end", "the end", " lead  two   spaces ", "a\t  b \n\n c\r\n d\n", "\n x", "x   y  z\x1c q", "▁ x a▁b",
       "ok <s> </s> <0x41> <|endoftext|> done", "日本語 ñ 🙂 é́ \x00 it's we'll", "a" * 30_000, " " * 3_000 + "x", "ab " * 50_000,
       "- - - . , 12 345 v1.2.3 http://x.y/?q=1&b=%20 ﬁ Å", "  ", " ", "x\n \n y　　 z"]


@pytest.mark.parametrize("chunk, frame, repeat", [(16_000_000, 4096, 1), (40, 3, 5)])
def test_odd_rows_in_one_chunk_or_many(spark, chunk, frame, repeat):
    texts = ODD * repeat
    docs = spark.createDataFrame([(None if i % 5 == 3 else i // 2, t, i) for i, t in enumerate(texts)], "doc_id long, text string, at long")
    docs = docs.withColumns({c: F.lit("mine") for c in ("chunk", "digit", "docs", "place", "n_a", "frames", "part")})
    spilled = token_alignment.cut(token_alignment.spill(docs, chunk=chunk, frame=frame), "runs")
    got = token_alignment.gather(spilled, token_alignment.merge(spilled, frame)).collect()
    want = brute(texts)
    assert sorted(((r.doc_id, *[r[c] for c in NAMES]) for r in got), key=str) == sorted(
        ((None if i % 5 == 3 else i // 2, *w) for i, w in enumerate(want)), key=str)
    if chunk == 40:
        assert spilled.select("chunk").distinct().count() > 10


def test_empty_table(spark):
    assert token_alignment.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
