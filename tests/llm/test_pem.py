"""Private keys are covered from header to footer, or through their base64."""

import base64
import random

from parley.llm import secrets
from parley.llm._shared import new_path

BODY = "\n".join(base64.b64encode(random.Random(1).randbytes(16 * 48)).decode()[i : i + 64] for i in range(0, 1024, 64)) + "\nqz8/AA=="
HEAD, FOOT = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def test_redact_covers_the_key(docs, spark):
    texts = [
        (1, f"a {HEAD}\n{BODY}\n{FOOT} b"), (2, f"a {HEAD}\n{BODY}\nthen some prose"), (3, f"a {HEAD}\nProc-Type: 4,ENCRYPTED\n\n{BODY}\n{FOOT}\nb"), (4, f"a {HEAD} and words"),
        (5, f"{HEAD} x {HEAD}\n{BODY}\n{FOOT}"), (6, "k=" + f"{HEAD}\n{BODY}\n{FOOT}".replace("\n", "\\n") + ";"), (7, f"a {HEAD} {BODY.splitlines()[0]} b"),
    ]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs(texts), new_path(spark, "ledger")).collect()}
    assert got == {1: "a [pem] b", 2: "a [pem]\nthen some prose", 3: "a [pem]\nb", 4: "a [pem] and words", 5: "[pem] x [pem]", 6: "k=[pem];", 7: "a [pem] b"}
