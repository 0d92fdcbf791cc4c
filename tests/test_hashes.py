"""Plans and chunks of four documents, serialised compactly, against recorded SHA-256 hashes.

The documents in ``data`` and the hashes are fixed values: published test inputs and their expected results.
"""

import hashlib
import json
from pathlib import Path

import pytest

from plectrum.operators import chunks, plan

HASHES = {
    "nested-regulation-01/literal": "3bb14c8f3a21dce6de92e5982ed5502b2a2e57ae72f3a00f34f50448fac749ad",
    "nested-regulation-01/listen": "7d2cf06e1a2c6b13cd6fdb6c567093d46cad3a1a46943c89fd958384390e1524",
    "financial-report-01/literal": "6c44052fd39c62c7d8e4b523cd7a914b1a04443f7e85ec1bb8c71e575f55e303",
    "financial-report-01/listen": "413a764d0272deb952eef6851a843540d9a2c5f9148214abdd54ebd2100e1e58",
    "extraction-artifacts-01/literal": "92ba5c57e42746dc7246ea10978936ef5624421de67ae56c1f95ba856852e407",
    "extraction-artifacts-01/listen": "5cc91e18428c680b3e46e72d1335287152b0f2d067b17e825461182d75339ccb",
    "simple-01/literal": "2ed7d6b46df36214f55dc326b6ac5817d98a3592de148208cdb56fd8514b99ec",
    "simple-01/listen": "c6225380893c4c969c70d3d394766947bfe0afcbeba6f9b2ca330a7ff02cb928",
}


@pytest.fixture(scope="module")
def documents():
    return [json.loads(p.read_text()) for p in sorted((Path(__file__).parent / "data").glob("*.json"))]


@pytest.mark.parametrize("mode", ["literal", "listen"])
def test_plans_and_chunks_have_the_recorded_hashes(spark, documents, mode):
    rows = [(d["id"], b["order"], b["type"], b["text"], b["page"], b.get("level")) for d in documents for b in d["blocks"]]
    blocks = spark.createDataFrame(rows, "doc_id string, ord int, type string, text string, page int, level int")
    made = (plan.literal_plan(blocks) if mode == "literal" else plan.listen_plan(blocks)).cache()
    segments, packed = made.collect(), chunks.plan_chunks(made, 400).collect()
    for d in documents:
        own = sorted((s for s in segments if s["doc_id"] == d["id"]), key=lambda s: s["ord"])
        heard, hits = [s for s in own if not s["muted"]], {}
        for s in heard:
            for t in s["transformations"]:
                hits[t["rule"]] = hits.get(t["rule"], 0) + 1
        changed = sum(bool(s["transformations"]) for s in heard) if mode == "listen" else 0
        assert not any(s["fallback"] for s in own)
        shown = [
            {
                "id": s["segment_id"], "sourceText": s["source_text"], "text": s["spoken_text"],
                "provenance": {"documentId": d["id"], "blockIds": [f"b{s['ord']}"], "pages": [s["page"]], "sourceStart": 0, "sourceEnd": len(s["source_text"].encode("utf-16-le")) // 2},
                "transformations": [{"ruleId": t["rule"], "source": t["source"], "replacement": t["replacement"]} for t in s["transformations"]],
                "fidelityOk": s["fidelity_ok"], "fallbackApplied": s["fallback"],
            }
            | ({"muted": True, "mutedBy": s["muted_by"]} if s["muted"] else {})
            for s in own
        ]
        stats = {
            "blocksTotal": len(own), "segments": len(heard), "mutedNoise": len(own) - len(heard), "transformed": changed,
            "unchanged": len(heard) - changed if mode == "listen" else 0, "rejected": 0, "ruleHits": hits,
        }
        told = {"documentId": d["id"], "mode": mode, "spokenEngineVersion": plan.ENGINE_VERSION, "segments": shown, "stats": stats}
        said = [{"id": f"c{c['chunk']}", "text": c["text"], "segmentIds": c["segment_ids"]} for c in sorted((c for c in packed if c["doc_id"] == d["id"]), key=lambda c: c["chunk"])]
        raw = json.dumps({"plan": told, "chunks": said}, ensure_ascii=False, separators=(",", ":"))
        assert hashlib.sha256(raw.encode()).hexdigest() == HASHES[f"{d['id'].removeprefix('ref-')}/{mode}"]
    made.unpersist()
