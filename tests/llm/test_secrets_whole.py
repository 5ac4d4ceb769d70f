"""Secrets are found whole, whatever their length."""

from jobweave.llm import pii


def test_long_secrets_and_key_blocks(spark, scratch):
    body = "Proc-Type: 4,ENCRYPTED\n" + "QWERTYUI" * 1200
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    jwt = "eyJ" + "a1B2" * 700 + "." + "c3D4" * 1300 + "." + "e5F6" * 400
    texts = ["password=" + "zQ" * 250 + " end", "DB_PASSWORD=hunterzz end", "sk-" + "kL" * 100 + " end", block + " end", jwt + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in pii.with_surrogates(df, "k", scratch).collect()}
    for i, part in enumerate(("zQzQ", "hunterzz", "kLkL", "QWERTYUI", "e5F6")):
        assert part not in got[i] and got[i].endswith(" end") and len(got[i]) == len(texts[i])
    assert "Proc-Type" not in got[3]
