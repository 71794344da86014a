import numpy as np

from hearth.llm import token_counts


def test_token_counts(spark, odd, empty, documents, texts):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    coder = token_counts.encoder(ranks, public_tokenizers.PATTERN)
    for block in (1 << 18, 37):  # documents across many blocks
        got = token_counts.token_counts(documents, ranks, public_tokenizers.PATTERN, block_tokens=block).collect()
        assert {r.doc_id: r.n_tokens for r in got} == {k: len(coder.encode_ordinary(t)) for k, t in texts.items()}
    got = token_counts.token_counts(odd, ranks, public_tokenizers.PATTERN, block_tokens=8)
    assert sorted(r.n_tokens for r in got.collect()) == sorted(len(coder.encode_ordinary(r.text or "")) for r in odd.collect())
    assert token_counts.token_counts(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_flat_files(spark, tmp_path):
    ids = np.array([1, 2, 9, 9, 3, 9, 4, 4, 4, 4, 4, 9, 7], np.uint16)
    for name in ("a.bin", "b c.bin"):
        (tmp_path / name).write_bytes(ids.tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    files = token_counts.list_flat(spark, str(tmp_path))
    for block in (1, 2, 3, 5, 100):
        rows = token_counts.count(files, 9, block_tokens=block, task_bytes=8).orderBy("file", "ordinal").collect()
        assert [(r.n_tokens, r.closed) for r in rows] == 2 * [(2, True), (0, True), (1, True), (5, True), (1, False)]


def test_flat_file_of_over_two_gigabytes(spark, tmp_path):
    size = (1 << 31) + 6  # a file with holes: it takes no room on the disk
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
        for at in (2, 1 << 20, (1 << 31) + 2):
            f.seek(at)
            f.write(np.uint16(9).tobytes())
    rows = token_counts.count(token_counts.list_flat(spark, str(tmp_path)), 9, block_tokens=1 << 22).orderBy("ordinal").collect()
    assert [(r.n_tokens, r.closed) for r in rows] == [(1, True), ((1 << 19) - 2, True), ((1 << 30) - (1 << 19), True), (1, False)]
