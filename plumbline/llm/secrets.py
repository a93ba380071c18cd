"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shelf import Shelf


def _any_case(word: str) -> str:
    """A word's letters in either case, for ASCII alone."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


# All patterns keep to what Java's engine and RE2 read alike: no look-around, no back-references, no possessive counts, and white space spelt out.
_BEGIN = "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
_END = "-----END [A-Z ]{0,24}PRIVATE KEY-----"
_GAP = r"(?:[ \t\r\n\f]|\\[rnt])"  #: white space, also as written in a JSON string
_PEM_HEAD = r"[A-Za-z-]+: [^\r\n\\]+"
#: Header lines and base64 through END, or the first lines of a truncated block.
_PEM = (f"{_BEGIN}(?:{_GAP}{{0,9}}{_PEM_HEAD}){{0,8}}(?:" r"[A-Za-z0-9+/= \t\r\n\f\\\"',]*" f"{_END}"
        f"|(?:{_GAP}{{1,9}}" r"[A-Za-z0-9+/=]{32,}" "){0,16})")
#: A key word with what follows in its name, up to the sign.
_WORD = "(?:" + "|".join((_any_case("passw") + "(?:[Oo][Rr])?[Dd]", _any_case("secret"), _any_case("token"), _any_case("api") + "[_-]?" + _any_case("key"))) + ")"
_ASSIGN = _WORD + r"[A-Za-z0-9_-]{0,24}\\?[\"']?[ \t\r\n\f]*[:=]=?>?"
# No group is repeated without bound: Java's engine takes a stack frame for each turn.
_DOUBLE, _SINGLE = (f"{q}[^{q}\\\\\\r\\n]{q}|{q}[^{q}\\r\\n][^\\r\\n]*?[^\\\\\\r\\n]{q}" for q in "\"'")
#: Quoted to its quote (one after a backslash is part of the value), to white space if no quote closes it on its line, after a quote that is
#: itself escaped, or unquoted on the line of its sign to white space.
_QUOTED = f"{_DOUBLE}|{_SINGLE}|" r"\\[\"'][^\"'\\\r\n]{8,}" r"""|"[^" \t\r\n\f]{8,}|'[^' \t\r\n\f]{8,}"""
_PLAIN = r"[^ \t\r\n\f\"'\\][^ \t\r\n\f]{7,}"
#: (kind, pattern): tried in this order at each place of a text.
_FORMS = (
    ("aws_access_key", "AKIA[0-9A-Z]{16}"),
    ("github_token", "gh[pousr]_[A-Za-z0-9]{36}"),
    ("slack_token", "xox[abprs]-[0-9A-Za-z-]{10,}"),
    ("google_api_key", "AIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", "[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
)
RULES = (
    *_FORMS,
    ("private_key", f"(?:{_ASSIGN}" r"[ \t\r\n\f]*\\?[\"']?" f")?{_PEM}"),  # an assigned key is no other value
    ("assigned_secret", f"{_ASSIGN}(?:" r"[ \t\r\n\f]*" f"(?:{_QUOTED})|" r"[ \t]*" f"{_PLAIN})"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in RULES)
#: Values that only illustrate: markers found in documentation.
PLACEHOLDER = "EXAMPLE|[Ee]xample|XXXX|xxxx|CHANGEME|[Cc]hangeme|YOUR_|[Yy]our_|00000000|12345678|[Pp]laceholder|[Dd]ummy"
WIDE_OWNERS = 5  #: a value that so many owners hold is an example that all copy; one owner's is live; in between it is shared
MIN_CHARS, LEAST_CHARS = 12, 8  #: characters of a credential; an assigned value of fewer than the second is none
# What makes the value of what was found; each is (pattern, replacement), applied in turn.
_STRIP_KEY = ((f"(?:{_ASSIGN}" r"[ \t\r\n\f]*\\?[\"']?" f")?{_BEGIN}|{_END}", ""), (_PEM_HEAD, ""), (r"\\[rnt]|[^A-Za-z0-9+/=]", ""))
_STRIP_SIGN = (f"^{_ASSIGN}" r"[ \t\r\n\f]*", "")
_STRIP_QUOTES = ((r"^\\?[\"']", ""), (r"[\"'\\,;]+$", ""))
_IS_QUOTED = f"^(?:{_DOUBLE}|{_SINGLE})$"
_KNOWN = "^(" + "|".join(f"(?:{p})" for _, p in _FORMS) + r")(?:[^A-Za-z0-9_/+=-](?s:.*))?$"  # a credential with a form of its own keeps to it
_PEM_START = f"^(?:{_ASSIGN}" r"[ \t\r\n\f]*\\?[\"']?" f")?{_BEGIN}"


def _replaced(value: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        value = F.regexp_replace(value, pattern, new)
    return value


def _kind(value: Column) -> Column:
    """The kind of a value, wherever it stood."""
    out = F
    for kind, pattern in _FORMS:
        out = out.when(value.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("assigned_secret")


def _key_body(found: Column) -> Column:
    """Base64 of a private key without white space; the header line if nothing follows it."""
    body = _replaced(found, *_STRIP_KEY)
    return F.when(body != "", body).otherwise(F.regexp_extract(found, _BEGIN, 0))


def _plain(found: Column) -> Column:
    """The value without what it is assigned to, its quotes and the separators after it."""
    value = _replaced(found, _STRIP_SIGN)
    bare = F.when(value.rlike(_IS_QUOTED), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(_replaced(value, *_STRIP_QUOTES))
    known = F.regexp_extract(bare, _KNOWN, 1)
    return F.when(value == found, found).when(known != "", known).otherwise(bare)


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
         repository: tuple[str, ...] = ("source", "lang"), wide_owners: int = WIDE_OWNERS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every secret found, with how widely the corpus carries it.

    One row for each document and distinct candidate in it: ``doc_id``,
    ``kind``, ``secret_hash`` (SHA-256 of the value; the value itself is never
    returned), ``occurrences`` in the document, and over the whole corpus
    ``n_docs``, ``n_repositories`` (distinct ``repository`` tuples),
    ``n_owners`` (distinct ``owner``) and ``verdict``:

    * ``example``: a placeholder, or held by ``wide_owners`` owners or more;
    * ``weak``: shorter than ``min_chars`` characters, or without a digit or a letter;
    * ``live``: any other value held by one owner;
    * ``shared``: any other value held by few, as when a document was copied.

    The kind is that of the value, and a value is counted under its hash alone:
    a token that is assigned somewhere and stands bare elsewhere is one secret.
    An assigned value goes to its closing quote, an unquoted one to white space
    (commas, semicolons and quotes at its end are not part of it), and so does
    one whose quote never closes on its line.
    The value of a private key is its base64 body without white space, so
    copies with other line ends are one secret; a block without END is told by
    its first sixteen full lines, and a header alone stands for itself.

    Null and empty texts hold nothing; very long texts are scanned whole.  A
    null id still counts as a document of its own row key; a null owner or
    repository part counts as one more value.  Ids are of any type.  Repeated
    rows add occurrences, not documents.  Ties cannot arise.  An empty table
    gives an empty result; further columns are ignored, whatever their names.

    The scan is one pass of JVM expressions over the text column.  The
    candidates found are written down, so that both the counts and the rows
    come from that pass; only they are shuffled, by document, then by hash with
    partial aggregation, so a credential copied a million times costs one row
    per map task.
    """
    repo = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in repository])
    hits = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("\u0002")).alias("owner"), repo.alias("repo"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).alias("found"))
    pem = F.col("found").rlike(_PEM_START)
    value = F.when(pem, _key_body(F.col("found"))).otherwise(_plain(F.col("found")))
    hits = hits.select("doc_id", "owner", "repo", pem.alias("pem"), value.alias("value"))
    kind = F.when(F.col("pem"), "private_key").otherwise(_kind(F.col("value")))
    hits = hits.where(F.length("value") >= LEAST_CHARS).select("doc_id", "owner", "repo", kind.alias("kind"), "value")
    hits = hits.select(
        "doc_id", "owner", "repo", "kind", F.sha2("value", 256).alias("secret_hash"),
        F.col("value").rlike(PLACEHOLDER).alias("placeholder"),
        ((F.length("value") >= min_chars) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).alias("strong"))
    per_doc = hits.groupBy("doc_id", "owner", "repo", "kind", "secret_hash").agg(
        F.count(F.lit(1)).alias("occurrences"), F.max("placeholder").alias("placeholder"), F.max("strong").alias("strong"))
    per_doc = Shelf(docs.sparkSession).put(per_doc)
    corpus = per_doc.groupBy("secret_hash").agg(
        F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0002"))).alias("n_docs"),
        F.count_distinct("repo").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))
    verdict = (F.when(F.col("placeholder") | (F.col("n_owners") >= wide_owners), "example").when(~F.col("strong"), "weak")
               .when(F.col("n_owners") == 1, "live").otherwise("shared"))
    rows = per_doc.groupBy("doc_id", "kind", "secret_hash").agg(
        F.sum("occurrences").alias("occurrences"), F.max("placeholder").alias("placeholder"), F.max("strong").alias("strong"))
    return rows.join(corpus, "secret_hash").select(
        "doc_id", "kind", "secret_hash", "occurrences", "n_docs", "n_repositories", "n_owners", verdict.alias("verdict"))


def scan_sql() -> str:
    """DuckDB SQL for :func:`scan` over ``documents`` with its default parameters."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def replaced(value: str, *steps: tuple[str, str], every: bool = True) -> str:
        for pattern, new in steps:
            value = f"regexp_replace({value}, {quote(pattern)}, {quote(new)}{', ' + quote('g') if every else ''})"
        return value

    kinds = " ".join(f"WHEN regexp_matches(value, {quote(f'^(?:{p})$')}) THEN {quote(k)}" for k, p in _FORMS)
    body = replaced("found", *_STRIP_KEY)
    return f"""
WITH hits AS (
  SELECT doc_id, coalesce(source, chr(2)) AS owner, coalesce(source, chr(2)) || chr(1) || coalesce(lang, chr(2)) AS repo,
         unnest(regexp_extract_all(text, {quote(PATTERN)})) AS found
  FROM documents),
cut AS (
  SELECT *, regexp_matches(found, {quote(_PEM_START)}) AS pem, {replaced('found', _STRIP_SIGN)} AS assigned, {body} AS body FROM hits),
bare AS (
  SELECT *, CASE WHEN regexp_matches(assigned, {quote(_IS_QUOTED)}) THEN substring(assigned, 2, length(assigned) - 2)
                 ELSE {replaced('assigned', *_STRIP_QUOTES)} END AS bare FROM cut),
valued AS (
  SELECT doc_id, owner, repo, pem,
    CASE WHEN pem THEN (CASE WHEN body <> '' THEN body ELSE regexp_extract(found, {quote(_BEGIN)}) END)
         WHEN assigned = found THEN found
         WHEN regexp_extract(bare, {quote(_KNOWN)}, 1) <> '' THEN regexp_extract(bare, {quote(_KNOWN)}, 1) ELSE bare END AS value
  FROM bare),
per_doc AS (
  SELECT doc_id, owner, repo, CASE WHEN pem THEN 'private_key' {kinds} ELSE 'assigned_secret' END AS kind, sha256(value) AS secret_hash, count(*) AS n,
         bool_or(regexp_matches(value, {quote(PLACEHOLDER)})) AS placeholder,
         bool_or(length(value) >= {MIN_CHARS} AND regexp_matches(value,'[0-9]') AND regexp_matches(value,'[A-Za-z]')) AS strong
  FROM valued WHERE length(value) >= {LEAST_CHARS} GROUP BY ALL),
corpus AS (
  SELECT secret_hash, count(DISTINCT coalesce(doc_id::VARCHAR, chr(2))) AS n_docs, count(DISTINCT repo) AS n_repositories,
         count(DISTINCT owner) AS n_owners
  FROM per_doc GROUP BY ALL),
per_id AS (
  SELECT doc_id, kind, secret_hash, sum(n)::BIGINT AS occurrences, bool_or(placeholder) AS placeholder, bool_or(strong) AS strong
  FROM per_doc GROUP BY doc_id, kind, secret_hash)
SELECT doc_id, kind, secret_hash, occurrences, n_docs, n_repositories, n_owners,
       CASE WHEN placeholder OR n_owners >= {WIDE_OWNERS} THEN 'example' WHEN NOT strong THEN 'weak' WHEN n_owners = 1 THEN 'live' ELSE 'shared' END AS verdict
FROM per_id JOIN corpus USING (secret_hash)"""
