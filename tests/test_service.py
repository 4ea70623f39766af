"""The HTTP routes, once over a socket and otherwise without."""

import json
import os
import signal
import subprocess
import sys
import threading
import urllib.error
import urllib.request

import pytest

from simloom.sources.catalog import Catalog
from simloom.sources.client import Client, Failed
from simloom.sources.service import Service, serve


def test_routes(spark, tmp_path):
    s = Service(Catalog(spark, str(tmp_path / "root")))
    do = lambda method, path, body=None: s.answer(method, path, "" if body is None else json.dumps(body))
    assert do("POST", "/collections", {"name": "c", "dim": 2, "metric": "l2"})[0] == 201
    assert do("POST", "/collections", {"name": "c", "dim": 2})[0] == 409
    assert do("POST", "/collections", {"name": "d"})[0] == 400
    assert do("POST", "/collections", {"name": "d", "dim": 2, "metric": "x"})[0] == 400
    assert do("GET", "/collections/none")[0] == 404 and do("GET", "/x")[0] == 404
    up = {"ids": [1, 2, 3], "vectors": [[0, 0], [1, 0], [0, 3]], "metadata": [{"t": "a"}, {"t": "b"}, {}]}
    assert do("POST", "/collections/c/upsert", up) == (200, {"upserted": 3})
    for bad in ({"ids": [1], "vectors": [[1]]}, {"ids": [-1], "vectors": [[1, 2]]}, {"ids": [1], "vectors": []}, {"ids": [1], "vectors": [[1, 2]], "metadata": [3]}):
        assert do("POST", "/collections/c/upsert", bad)[0] == 400
    assert do("POST", "/collections/c/query", {"vector": [0, 0], "k": 2}) == (200, {"results": [{"id": 1, "distance": 0.0, "metadata": {"t": "a"}}, {"id": 2, "distance": 1.0, "metadata": {"t": "b"}}]})
    assert do("POST", "/collections/c/query", {"vectors": [[0, 0], [0, 3]], "k": 1, "filter": {"t": {"$ne": "a"}}, "include_metadata": False}) == (200, {"results": [[{"id": 2, "distance": 1.0}], [{"id": 3, "distance": 0.0}]]})
    assert do("POST", "/collections/c/query", {"vector": [0, 0], "k": 0})[0] == 400
    assert do("POST", "/collections/c/query", {"vector": [0, 0], "filter": {"t": {"$gt": 1}}})[0] == 400
    assert s.answer("POST", "/collections/c/query", "{")[0] == 400
    assert do("POST", "/collections/c/delete", {"ids": [2, 9]}) == (200, {"deleted": 1})
    assert do("GET", "/collections/c/points/2")[0] == 404
    assert do("GET", "/collections/c/points/3") == (200, {"id": 3, "vector": [0.0, 3.0], "metadata": {}})
    assert do("POST", "/collections/c/checkpoint")[1]["snapshot_seq"] == 2

    server = serve(s, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_address[1]}"
        assert json.load(urllib.request.urlopen(f"{at}/health"))["status"] == "ok"
        assert [c["name"] for c in json.load(urllib.request.urlopen(f"{at}/collections"))["collections"]] == ["c"]
        assert b'errors_total{route="upsert"} 4' in urllib.request.urlopen(f"{at}/metrics").read()
        try:
            urllib.request.urlopen(f"{at}/collections/none")
            raise AssertionError
        except urllib.error.HTTPError as e:
            assert e.code == 404
    finally:
        server.shutdown()
        server.server_close()
    s.close()
    assert do("DELETE", "/collections/c") == (200, {"dropped": "c"}) and do("GET", "/collections")[1] == {"collections": []}


def test_client(spark, tmp_path):
    s = Service(Catalog(spark, str(tmp_path / "root"), fsync=False))
    server = serve(s, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = Client(f"http://127.0.0.1:{server.server_address[1]}/")
        assert c.health()["status"] == "ok" and c.collections() == []
        assert c.create("k", 2, metric="ip", quantization="sq8")["quantization"] == "sq8"
        with pytest.raises(Failed) as e:
            c.create("k", 2)
        assert e.value.status == 409
        assert c.upsert("k", [7, 8], [[1, 0], [0, 1]], [{"a": 1}, {}]) == 2
        assert [h["id"] for h in c.query("k", [1, 0.5], 5)] == [7, 8] and [len(h) for h in c.query("k", [[1, 0], [0, 1]], 1, filter={"a": 1}, include_metadata=False)] == [1, 1]
        assert c.get("k", 7)["metadata"] == {"a": 1} and c.get("k", 9) is None and c.delete("k", [8, 9]) == 1
        assert c.checkpoint("k")["snapshot_seq"] == 2 and c.stats("k")["size"] == 1 and "requests_total" in c.metrics()
        c.drop("k")
        assert c.collections() == []
    finally:
        server.shutdown()
        server.server_close()


@pytest.mark.skipif(not hasattr(signal, "SIGTERM"), reason="needs signals")
def test_command_line(tmp_path):
    """Served from the command line; when told to end, everything is checkpointed."""
    p = subprocess.Popen([sys.executable, "-m", "simloom.sources.service", "--data-dir", str(tmp_path / "root"), "--port", "0", "--threads", "1", "--no-fsync"], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    try:
        line = next(x for x in p.stdout if x.startswith("serving"))
        c = Client(f"http://{line.split()[-1]}", timeout=300)
        c.create("n", 2)
        c.upsert("n", [1], [[1, 2]])
        p.send_signal(signal.SIGTERM)
        assert p.wait(300) == 0
    finally:
        p.kill()
    assert any(x.name.startswith("snap-") for x in (tmp_path / "root" / "n").iterdir())
