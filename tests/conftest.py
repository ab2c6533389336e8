from __future__ import annotations

import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewell.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class Tree:
    """A source directory under test; files get explicit modification times."""

    def __init__(self, root):
        self.root = str(root)

    def write(self, path: str, content, mtime: float = 1_700_000_000.0) -> str:
        full = os.path.join(self.root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        data = content if isinstance(content, bytes) else content.encode()
        with open(full, "wb") as f:
            f.write(data)
        os.utime(full, (mtime, mtime))
        return full

    def jsonl(self, path: str, rows: list, mtime: float = 1_700_000_000.0) -> str:
        lines = [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows]
        return self.write(path, "\n".join(lines) + "\n", mtime)


@pytest.fixture
def tree(tmp_path):
    return Tree(tmp_path / "src")


def rec(uuid, content=None, **kw):
    """A transcript record; keyword arguments override fields, tokens go under usage."""
    message = {"role": kw.pop("role", "assistant")}
    for key in ("model", "stop_reason"):
        if key in kw:
            message[key] = kw.pop(key)
    if "tokens" in kw:
        names = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
        message["usage"] = dict(zip(names, kw.pop("tokens")))
    if content is not None:
        message["content"] = content
    out = {"type": "assistant", "uuid": uuid, "sessionId": "S", "timestamp": "2024-01-01T00:00:00Z", "message": message}
    out.update(kw)
    return {k: v for k, v in out.items() if v is not ...}
