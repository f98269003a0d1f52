"""Files arriving in job folders are screened, unreadable ones become failed rows."""

from shortlist import schemas
from shortlist.functions import fixed
from shortlist.streaming.ingest import stream_files

GOOD = "Built Node.js services. Ran Node.js. More Node.js for all of them, and then some."


def drop(folder, files):
    for name, data in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def test_stream_of_files_with_bad_ones_and_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixed, "MAX_UPLOAD_BYTES", 5000)
    reqs = spark.createDataFrame([("dev", 0, "r1", "Node", "technology", 9, True, ["node.js"], [])], schemas.REQUIREMENT_ROW)

    def decode(data):
        if data.startswith(b"broken"):
            raise ValueError("not a document")
        return data.decode().upper()

    def run():
        query = stream_files(
            spark, str(tmp_path / "in"), lambda: reqs, str(tmp_path / "sink"), str(tmp_path / "check"), {"docx": decode}, files_per_batch=2
        )
        query.awaitTermination(240)
        assert query.exception() is None
        return {r.original_filename: r for r in spark.read.parquet(str(tmp_path / "sink")).collect()}

    drop(tmp_path / "in", {
        "job=dev/a b é.txt": GOOD.encode(), "job=dev/bytes.txt": b"\xff\xfe broken bytes " + GOOD.encode(), "job=dev/b.png": b"\x89PNG",
        "job=dev/c.docx": GOOD.encode(), "job=dev/d.docx": b"broken", "job=dev/e.pdf": b"%PDF", "job=dev/big.txt": b"x" * 6000, "other/f.txt": GOOD.encode(),
        "job=dev/empty.txt": b"",  # Spark's file source does not list files without bytes
    })
    got = run()
    tiers = {name: r.tier for name, r in got.items()}
    assert tiers == {
        "a b é.txt": "great", "bytes.txt": "great", "b.png": "no-match", "c.docx": "great", "d.docx": "no-match", "e.pdf": "no-match",
        "big.txt": "no-match", "f.txt": "no-match",
    }
    reasons = {name: r.elimination_reason for name, r in got.items()}
    assert reasons["d.docx"] == "Could not read file: not a document"
    assert reasons["e.pdf"] == "Could not read file: no decoder for pdf"
    assert reasons["big.txt"] == f"Could not read file: {fixed.REASON_TOO_LARGE}"
    assert reasons["b.png"].startswith("Could not read file: Unsupported file type")
    assert got["f.txt"].job_position_id == "other" and got["a b é.txt"].job_position_id == "dev"
    assert "�" in got["bytes.txt"].raw_text and got["c.docx"].raw_text == GOOD.upper()
    drop(tmp_path / "in", {"job=dev/late.txt": GOOD.encode()})
    again = run()
    assert len(again) == len(got) + 1 and len({r.cv_id for r in again.values()}) == len(again)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == len(again)
