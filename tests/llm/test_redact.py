from sievetree.llm import secret_scan

BODY = "\n".join("MIIEpAIBAAKCAQEA" + "q7Xz+/9k" * 6 for _ in range(25)) + "\nAbCd=="
TEXTS = {
    1: (f"before\n-----BEGIN RSA PRIVATE KEY-----\n{BODY}\n-----END RSA PRIVATE KEY-----\nafter", "before\n[SECRET]\nafter"),
    2: (f"-----BEGIN PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{BODY}\n-----END PRIVATE KEY----- x", "[SECRET] x"),
    3: (f"cut off -----BEGIN EC PRIVATE KEY-----\n{BODY}", "cut off [SECRET]"),
    4: ("it starts with -----BEGIN PRIVATE KEY----- and prose. Stays", "it starts with [SECRET] and prose. Stays"),
    5: ("nothing here", "nothing here"),
}


def test_a_private_key_goes_whole(spark):
    docs = spark.createDataFrame([(i, t, len(t)) for i, (t, _) in TEXTS.items()], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact(docs).collect()}
    assert got == {i: (want, len(want)) for i, (_, want) in TEXTS.items()}
