"""What the secret scan takes as the value of a credential."""

from plumbline.llm import secrets


def scanned(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id bigint, text string, lang string, source string")
    return {(r.doc_id, r.kind): r for r in secrets.scan(df).collect()}


def pem(char, n=20):
    return ["-----BEGIN RSA PRIVATE KEY-----", *[f"{char}4+/" * 16] * n, f"{char}Q1==", "-----END RSA PRIVATE KEY-----"]


def test_private_keys(spark):
    a, b, c = pem("a"), pem("b"), pem("c")
    head = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF", ""]
    got = scanned(spark, [(1, "see\n" + "\n".join(a) + "\nend", "a"), (2, "\n".join(b), "b"), (3, '{"key": "' + "\\n".join(b) + '\\n"}', "b"), (4, "\r\n".join(b), "b"),
                          (5, "\n".join(c[:9]) + "\nand more prose", "c"), (6, "\n".join([c[0], *head, *c[1:]]), "d"), (7, "-----BEGIN RSA PRIVATE KEY----- is how it begins", "e"),
                          (8, "\n".join(pem("d", 5000)), "f")])
    assert len(got) == 8
    one, two = got[1, "private_key"], got[2, "private_key"]
    assert one.secret_hash != two.secret_hash and (one.verdict, two.verdict) == ("live", "live") and (one.n_owners, two.n_owners) == (1, 1)
    assert {got[i, "private_key"].secret_hash for i in (2, 3, 4)} == {two.secret_hash} and two.n_docs == 3
    assert len({r.secret_hash for r in got.values()}) == 6 and got[7, "private_key"].verdict == "weak"
    assert {got[i, "private_key"].verdict for i in (5, 6, 8)} == {"live"}


def test_assigned_and_bare_are_one_secret(spark):
    tokens = ["ghp_" + "a1" * 18, "AKIA" + "ABCDEFGH12345QRS", "AIza" + "a1b2c" * 7, "sk_" + "live_" + "a1" * 12]
    rows = [(10 * i + k, t, s) for i, v in enumerate(tokens) for k, (t, s) in enumerate([(f'token = "{v}"', "a"), (f"see {v} there", "b")])]
    got = scanned(spark, rows)
    assert {k for _, k in got} == {"github_token", "aws_access_key", "google_api_key", "stripe_key"} and len(got) == 8
    assert all((r.n_docs, r.n_repositories, r.n_owners) == (2, 2, 2) for r in got.values())


def test_assigned_values_are_whole(spark):
    import hashlib

    forms = ["password=Summer2024!a", "password=Summer2024!b", '{"api_key": "k3y-of.json#1"}', "aws_secret_access_key = wJalr/K7MD+ENG==", "secret_key=p@ss:w0rd%99", "token   =  abc123def456",
             "Password: P@ssw0rd!x99", "password = 'it has 2 blanks'", '"{\\"token\\": \\"escaped!1234\\"}"', 'secret = "unclosed!1234 and', 'secret = "with \\" quote inside 12"', 'token="ab" and "cd"', "Password:\nfollowing1text",
             "API_KEY => 'a1b2c3d4e5f6!';", "token\t:\tunquoted!1234,", '"client_secret":\n  "next-line!99"']
    values = ["Summer2024!a", "Summer2024!b", "k3y-of.json#1", "wJalr/K7MD+ENG==", "p@ss:w0rd%99", "abc123def456", "P@ssw0rd!x99", "it has 2 blanks", "escaped!1234", "unclosed!1234",
              'with \\" quote inside 12', None, None, "a1b2c3d4e5f6!", "unquoted!1234", "next-line!99"]
    got = scanned(spark, [(i, f, f"s{i}") for i, f in enumerate(forms)])
    assert {i: r.secret_hash for (i, _), r in got.items()} == {i: hashlib.sha256(v.encode()).hexdigest() for i, v in enumerate(values) if v}
    assert {r.verdict for r in got.values()} == {"live"}
    # The SQL reads every one of these forms alike.
    import duckdb
    import pandas as pd

    documents = pd.DataFrame([(i, f, "en", f"s{i}") for i, f in enumerate(forms)], columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    sql = {(r[0], r[1]): r[2:] for r in duckdb.sql(secrets.scan_sql()).fetchall()}
    assert sql == {k: tuple(r)[2:] for k, r in got.items()}
    long = scanned(spark, [(1, 'token = "' + "ab\\\"1" * 200_000 + '"', "a"), (2, "token = " * 20_000, "a"), (4, "-----BEGIN PRIVATE KEY-----" + ("\n" + "aB3/" * 16) * 20_000, "a"), (5, "-----BEGIN PRIVATE KEY-----\n" * 20_000, "a"), (3, 'secret="' + "x1" * 200_000, "b")])
    assert {i for i, _ in long} >= {1, 3}


def test_spread_tells_copies_from_leaks(spark):
    rows = [(i, f"token = v4lue{n}abcdef" + "z" * n, f"s{k}") for n in (1, 2, secrets.WIDE_OWNERS - 1, secrets.WIDE_OWNERS) for k in range(n) for i in [100 * n + k]]
    got = scanned(spark, rows)
    assert {r.n_owners: r.verdict for r in got.values()} == {1: "live", 2: "shared", secrets.WIDE_OWNERS - 1: "shared", secrets.WIDE_OWNERS: "example"}


def test_long_tokens_are_whole(spark):
    import hashlib

    slack, stripe = "xox" + "b-" + "a1" * 60, "sk_" + "live_" + "b2" * 60
    got = scanned(spark, [(1, slack, "a"), (2, stripe, "a"), (3, f"token={slack}", "a")])
    assert {r.secret_hash for r in got.values()} == {hashlib.sha256(v.encode()).hexdigest() for v in (slack, stripe)}


def test_assigned_private_key(spark):
    b = "\n".join(pem("b"))
    got = scanned(spark, [(1, b, "a"), (2, f'secret = "{b}"', "a"), (3, "my_secret: " + b.replace("\n", "\\n"), "a")])
    assert len({r.secret_hash for r in got.values()}) == 1 and {k for _, k in got} == {"private_key"}
