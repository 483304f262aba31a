import pyarrow as pa
import public_tokenizers

from hearthline.llm import packing


def test_workers_remember_as_many_runs_as_they_may(monkeypatch):
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    texts = [" ".join(f"w{k}x{i}" for k in range(50)) for i in range(5000)]
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": texts})

    def crcs(most):
        parts = packing._pieces(path, 4096, 1, False, most)(iter([batch]))
        return [x for b in parts for x in b.column("ids_crc32").to_pylist()]

    few = crcs(60_000)
    tables = packing.remembered(path)[1]
    assert all(len(t) <= 250_000 for t in tables) and crcs(800_000) == few
