"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame and SQL only.

A candidate is a block of a private key, a password in an address, a token of a known vendor's shape, any eight or more characters
without white space after the name of a secret, or a run of at least twelve base64-like characters with
a digit.  The forest sees its length, character transitions, dictionary coverage, whether it stands in a path, and the words and
signs beside it.  It is trained by MLlib on labelled findings and then written out as one SQL
expression, so that scoring is part of the scan's own projection: no shuffle, no join, no Python.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters beside a candidate that its features look at.
BEFORE, AFTER = 64, 16
TREES, DEPTH = 24, 6
LEAST = 0.5
#: Labelled findings that the forest learns from at most: those of the least hashes beyond that.
MAX_FINDINGS = 200_000
MASK = "[SECRET]"

_NAMES = "token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|credential|bearer"
_BENIGN = "commit|revision|rev|sha[0-9]*|md5|checksum|digest|hash|etag|uuid|guid|card|phone|call|order|invoice|account|isbn|build|version"
#: Vendors' tokens, whether or not they hold a digit.
_SHAPES = (
    "(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{20,}+"
    "|eyJ[A-Za-z0-9_-]{8,}+[.][A-Za-z0-9_-]++(?:[.][A-Za-z0-9_-]++)?+|hf_[A-Za-z0-9]{20,}+|npm_[A-Za-z0-9]{20,}+|glpat-[A-Za-z0-9_-]{16,}+|SG[.][A-Za-z0-9=_-]{16,}+[.][A-Za-z0-9=_-]{16,}+|pplx-[A-Za-z0-9]{20,}+"
    "|AGE-SECRET-KEY-1[A-Z0-9]{20,}+|sgp_[A-Za-z0-9_]{20,}+|sl[.][A-Za-z0-9=_-]{40,}+|do[opr]_v1_[a-f0-9]{20,}+|shp(?:at|ca|pa|ss)_[A-Za-z0-9]{20,}+|lin_api_[A-Za-z0-9]{20,}+|pypi-[A-Za-z0-9_-]{20,}+|PMAK-[a-f0-9-]{20,}+|[0-9]{5,16}:AA[A-Za-z0-9_-]{33}"
)
#: A private key from its first line to its last.
_KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s:,.-]{16,}?-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
_VENDOR = f"^(?:{_SHAPES})|^eyJ|^-----BEGIN "
#: What leads to a value: the user in an address, the names of a secret with their sign.
_USER = r"://[^\s:/@]*+:"
_NAMED = rf"(?:(?=[tspacbTSPACB])(?i:(?:{_NAMES})[a-z0-9_.-]*+[\x22\x27]?+(?:\s*+[:=]++>?+\s*+|\s++is\s++)[\x22\x27\x60]?+(?:bearer\s++)?+|bearer\s++))++"
_LEAD = rf"^(?:{_USER}|{_NAMED})(?=\S)"
_RUN = "[A-Za-z0-9+/_-]"
#: A value that a quote opened ends at the same quote; any other ends before white space, closing signs left out.
_VALUE = r"(?:(?<=\x22)[^\s\x22]{8,}+(?=\x22)|(?<=\x27)[^\s\x27]{8,}+(?=\x27)|(?<=\x60)[^\s\x60]{8,}+(?=\x60)|[^\s\x22\x27\x60<>]{7,}[^\s\x22\x27\x60<>,;:.!?)\]}]|\S{8,}+)"
#: With its lead, if it has one.  A vendor's token inside a named value stands for itself, and a run that holds
#: the name of a value is none.
CANDIDATE = (
    rf"{_KEY_BLOCK}|{_USER}(?:[^\s/]+(?=@)|[^\s@]+(?=@))"
    rf"|(?<![A-Za-z0-9])(?:{_SHAPES})={{0,2}}"
    rf"|{_NAMED}(?!\S*?(?:(?<![A-Za-z0-9])(?:{_SHAPES})|{_USER}[^\s@]+@)){_VALUE}"
    rf"|(?<!{_RUN})(?=[A-Za-z+/_-]*+[0-9])(?!{_RUN}*?{_NAMED}(?=\S{{8}})){_RUN}{{12,}}+={{0,2}}"
)
_PLACEHOLDER = "example|sample|changeme|placeholder|your|dummy|xxxx|test|12345678|redacted|default"
_WORDS = (
    "about account action address admin after agent align alpha amount android answer apple archive article asset author backup banner batch before beta between block board book branch "
    "browser buffer build button cache call camera card center chapter check child class client cloud code color column comment commit common company config content control copy count "
    "country create current custom data date debug default delete design detail device document domain download draft editor email enable engine entry error event example export feature "
    "field file filter final first folder font footer form format forward frame function general global graph group guide header height history home host icon image import index info input "
    "install interface internal invoice item journal kernel label language large layout level library light linear link list local login machine main manager master media member memory menu "
    "message method mobile model module month movie name network number object office option order output package page paper param part photo place player plugin point policy post preview "
    "price print process product profile program project public query record region release remote render report request resource response result revision root sample schema screen script "
    "search section security select server service session setting short small source stage standard start state static status step storage store stream string style summary support switch "
    "system table target task team template test text theme thread thumb time title token tool topic track traffic train type unit update upload user value version video view volume watch "
    "width window word work write year zone"
).split()

#: Features by name, over the fields ``prior``, ``found`` and ``next`` of a candidate ``x``.
FEATURES = {
    "size": "cast(length(x.found) AS double)",
    "transitions": "(length(regexp_replace(x.found, '[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+', 'x')) - 1) / length(x.found)",
    "digits": "length(regexp_replace(x.found, '[^0-9]', '')) / length(x.found)",
    "upper": "length(regexp_replace(x.found, '[^A-Z]', '')) / length(x.found)",
    "vowels": "length(regexp_replace(x.found, '[^aeiouAEIOU]', '')) / length(x.found)",
    "marks": "length(regexp_replace(x.found, '[A-Za-z0-9]', '')) / length(x.found)",
    "distinct_chars": "cast(size(array_distinct(split(lower(x.found), ''))) AS double)",
    "hex": "cast(x.found rlike '^[0-9a-f]+$|^[0-9A-F]+$' AS double)",
    "all_digits": "cast(x.found rlike '^[0-9]+$' AS double)",
    "dictionary": f"1 - length(regexp_replace(lower(x.found), '{'|'.join(w for w in _WORDS if len(w) > 3)}', '')) / length(x.found)",
    "placeholder": f"cast(lower(x.found) rlike '{_PLACEHOLDER}' AS double)",
    "vendor": f"cast(x.found rlike '{_VENDOR}' AS double)",
    "url_password": r"cast(x.prior rlike '://[^\\s:/@]*:$' AND x.next rlike '^@' AS double)",
    "code": r"cast(x.found rlike '[(){}<>$\\[\\]]|^[a-z_]+[.][a-z_.]+$' AS double)",
    "path": r"cast(x.prior rlike '[/\\\\.@]$' OR x.next rlike '^[/\\\\@]|^\\.[A-Za-z]' OR x.found rlike '/[^/]*/' AS double)",
    "named": rf"cast(lower(x.prior) rlike '(?:{_NAMES})[a-z0-9_.-]*[\\x22\\x27]?\\s*(?:[:=]+>?|is)\\s*[\\x22\\x27`]?(?:bearer\\s+)?$' AS double)",
    "name_near": f"cast(lower(x.prior) rlike '{_NAMES}' AS double)",
    "assigned": r"cast(x.prior rlike '[:=]\\s*[\\x22\\x27`]?$' AS double)",
    "quoted": r"cast(x.prior rlike '[\\x22\\x27`]$' AND x.next rlike '^[\\x22\\x27`]' AS double)",
    "benign": rf"cast(lower(x.prior) rlike '(?:{_BENIGN})[^a-z0-9]*(?:is|no|number|id)?[^a-z0-9]*$' AS double)",
}


def _candidates(text: str) -> str:
    """SQL: the candidates of a text as structs of the text before, the match, the text after, and the
    characters from the last match's end to it."""
    pattern, lead = CANDIDATE.replace("\\", "\\\\"), _LEAD.replace("\\", "\\\\")
    whole = (
        f"transform(arrays_zip(split({text}, '{pattern}', -1), regexp_extract_all({text}, '{pattern}', 0), slice(split({text}, '{pattern}', -1), 2, 2147483647)),"
        f" p -> struct(concat(p['0'], regexp_extract(p['1'], '{lead}', 0)) AS gap, p['1'] AS found, length(regexp_extract(p['1'], '{lead}', 0)) AS led, left(p['2'], {AFTER}) AS next))"
    )
    return f"transform({whole}, p -> struct(right(p.gap, {BEFORE}) AS prior, substr(p.found, p.led + 1) AS found, p.next AS next, p.gap AS gap))"


def _with_features(array: str) -> str:
    return f"transform({array}, x -> struct(x.prior, x.found, x.next, x.gap, " + ", ".join(f"coalesce({sql}, 0D) AS {name}" for name, sql in FEATURES.items()) + "))"


def labelled_findings(spark: SparkSession, n: int = 240) -> DataFrame:
    """Labelled findings made by rule: ``prior``, ``found``, ``next``, ``label``; ``n`` of each kind.

    Assigned hexadecimal, base64 and mixed keys and passwords, vendor keys in prose, passwords in
    addresses and bearer tokens are secrets; numbers, digests, identifiers, paths, ports, placeholders,
    code, prose and words with digits are not.
    """
    seed = "sha2(concat(kind, ':', cast(id AS string)), 256)"
    kinds = {
        # kind: (label, prior, found, next)
        "hex": (1, "concat(name, op, quote)", "left(h, 16 + id % 41)", "quote"),
        "HEX": (1, "concat(upper(name), op, quote)", "upper(left(h, 18 + id % 39))", "quote"),
        "base64": (1, "concat(name, op, quote)", "translate(base64(unhex(left(h, 32 + 2 * (id % 17)))), '=', '')", "quote"),
        "mixed": (1, "concat(name, op, quote)", "concat(left(base64(unhex(h)), 9), left(h, 5 + id % 12))", "quote"),
        "near": (1, "concat('the ', name, ' is ')", "left(h, 20 + id % 21)", "' '"),
        "vendor": (1, "concat(word, ' ')", "concat('AKIA', upper(translate(left(h, 16), '0189', 'WXYZ')))", "' '"),
        "github": (1, "concat(word, ' ')", "concat('ghp_', left(translate(base64(unhex(h)), '+/=', 'abc'), 36))", "' '"),
        "service": (1, "concat(name, op, quote)", "concat('sk_live_', left(h, 24))", "quote"),
        "held": (1, "concat(name, op, quote)", "concat(left(h, 8 + id % 5), element_at(array('12345678', 'test', 'xxxx', 'default'), cast(id % 4 AS int) + 1), substr(h, 14, 14 + id % 20))", "quote"),
        "short": (1, "concat(name, op, quote)", "concat(left(letters, 4 + id % 4), id % 10, substr(b, 9, 3))", "quote"),
        "lower": (1, "concat(name, op, quote)", "concat(lower(left(letters, 5 + id % 3)), id % 10, lower(substr(letters, 9, 2)))", "quote"),
        "punctuated": (1, "concat(name, op, quote)", "concat(left(b, 4), element_at(array('!', '@', '&', '#', '%', '*'), cast(id % 6 AS int) + 1), substr(b, 5, 3 + id % 5), element_at(array('!', '#', '$', '^', '?'), cast(id % 5 AS int) + 1), left(h, 2))", "quote"),
        "worded": (1, "concat(name, op, quote)", "concat(initcap(translate(word, 'aeo', '430')), '!', substr(letters, 3, 3), '#', word2)", "quote"),
        "phrase": (1, "concat(element_at(array('password', 'db_password', 'passwd', 'pwd'), cast(id % 4 AS int) + 1), op, quote)", "concat(word, element_at(array('-', '_', ' ', ''), cast(id % 2 AS int) + 1), word2, '-', substr(letters, 2, 4), element_at(array('!', '?', '#', '&'), cast(id % 4 AS int) + 1), word)", "quote"),
        "key_block": (1, "concat(element_at(array('key: ', '', 'here '), cast(id % 3 AS int) + 1), '')", "concat('-----BEGIN ', element_at(array('RSA ', '', 'EC '), cast(id % 3 AS int) + 1), 'PRIVATE KEY-----', chr(10), left(base64(unhex(concat(h, h))), 64), chr(10), left(b, 20 + id % 20), chr(10), '-----END ', element_at(array('RSA ', '', 'EC '), cast(id % 3 AS int) + 1), 'PRIVATE KEY-----')", "chr(10)"),
        "letters": (1, "concat(name, op, quote)", "left(letters, 14 + id % 20)", "quote"),
        "face": (1, "concat(word, ' ')", "concat('hf_', left(letters || reverse(letters), 34))", "' '"),
        "letter_id": (1, "concat(word, ' ')", "concat('AKIA', upper(left(letters, 16)))", "' '"),
        "jwt": (1, "concat(word, ' ')", "concat('eyJ', left(b, 20), '.eyJ', substr(b, 3, 30), '.', letters)", "' '"),
        "url": (1, "concat(element_at(array('postgres', 'https', 'redis', 'amqp'), cast(id % 4 AS int) + 1), '://', if(id % 7 = 0, '', word), ':')", "concat(left(lower(letters), 1 + id % 6), id % 10, substr(b, 3, 3 + id % 7))", "concat('@', word2)"),
        "prose": (0, "concat(name, element_at(array(' is ', ': ', ' = ', '='), cast(id % 4 AS int) + 1))", "element_at(array('something', 'required', 'important', 'everything', 'necessary', 'available', 'somewhere', 'Christopher', 'obviously', 'published', 'forgotten', 'generated'), cast(pmod(hash(h), 12) AS int) + 1)", "' '"),
        "prose_words": (0, "concat(name, element_at(array(' is ', ': ', ' = '), cast(id % 3 AS int) + 1))", "concat(word, element_at(array('', '-', '_', '/'), cast(id % 4 AS int) + 1), word2, 'ing')", "' '"),
        "code": (0, "concat(name, op)", "element_at(array(concat('get', initcap(word), '()'), concat(word, '.', word2), concat('os.environ[', upper(word), ']'), concat('self.', word, '_', word2), concat(word, '(', word2, ')')), cast(id % 5 AS int) + 1)", "' '"),
        "hole": (0, "concat(name, op, quote)", "element_at(array(concat('<', word, '_', word2, '>'), concat('${', upper(word), '_', upper(word2), '}'), concat('{{', word, word2, '}}'), '************', '............'), cast(id % 5 AS int) + 1)", "quote"),
        "port": (0, "concat('https://', word, '.org:')", "concat(8000 + id, '/', word, if(id % 2 = 0, '/', '?q='), word2)", "concat('@', word)"),
        "vendorish": (0, "concat(word, ' ')", "concat(element_at(array('sk_', 'pk-', 'rk_'), cast(id % 3 AS int) + 1), word, '_', word2, '_', word, '_', word2)", "' '"),
        "number": (0, "concat(word, ' ')", "lpad(cast(conv(left(h, 12), 16, 10) AS string), 16, '4')", "' '"),
        "assigned_number": (0, "concat(word, op)", "lpad(cast(conv(left(h, 10), 16, 10) AS string), 13, '1')", "' '"),
        "digest": (0, "concat(benign, ' ')", "left(h, 32 + 8 * (id % 2))", "' '"),
        "digest_op": (0, "concat(benign, op)", "left(h, 40)", "' '"),
        "bare_hex": (0, "concat(word, ' ')", "left(h, 12 + id % 29)", "'. '"),
        "uuid": (0, "concat(word, ' ')", "concat_ws('-', left(h, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", "' '"),
        "path": (0, "concat('/', word, '/')", "concat(word, '/', word2, '_', left(h, 4), '1')", "'.png'"),
        "address": (0, "'https://'", "concat(word, word2, '-', left(h, 3), '7')", "'.example.org/'"),
        "identifier": (0, "concat(word, ' ')", "concat(word, '_', word2, '_', cast(id AS string), '4')", "' '"),
        "assigned_word": (0, "concat(name, op, quote)", "concat(word, '_', word2, '_', word, '1')", "quote"),
        "placeholder": (0, "concat(name, op, quote)", "concat(element_at(array('your-', 'example_', 'changeme', 'dummy-', 'test_'), cast(id % 5 AS int) + 1), word, '-12345678')", "quote"),
        "word": (0, "concat(word, ' ')", "concat(word, word2, word, cast(id % 90 + 10 AS string))", "' '"),
    }
    names, benign = ("token", "api_key", "secret", "password", "db_password", "auth_token", "access_key", "pwd", "client_secret"), ("commit", "sha256", "md5", "checksum", "digest", "revision", "uuid", "order", "card")
    pick = lambda values, salt: f"element_at(array({', '.join(repr(v) for v in values)}), cast(pmod(id * 31 + {salt}, {len(values)}) AS int) + 1)"
    rows = spark.range(0, n, 1, 1).selectExpr("id", f"explode(array({', '.join(repr(k) for k in kinds)})) AS kind").selectExpr("id", "kind", f"{seed} AS h")
    rows = rows.selectExpr(
        "*", "translate(base64(unhex(h)), '+/=', 'xyz') AS b", "left(translate(base64(unhex(h)), '0123456789+/=', 'kLmNpQrStVxyz'), 43) AS letters", f"{pick(names, 3)} AS name", f"{pick(benign, 5)} AS benign", f"{pick(_WORDS, 11)} AS word", f"{pick(_WORDS, 57)} AS word2", f"{pick(('=', ' = ', ': ', ':', ' := '), 1)} AS op", "element_at(array('', '\"', ''''), cast(id % 3 AS int) + 1) AS quote"
    )
    by_kind = lambda at: "CASE kind " + " ".join(f"WHEN '{k}' THEN {kind[at]}" for k, kind in kinds.items()) + " END"
    return rows.selectExpr(f"concat('and the ', {by_kind(1)}) AS prior", f"{by_kind(2)} AS found", f"{by_kind(3)} AS next", f"cast({by_kind(0)} AS double) AS label")


_FITTED: dict[str, str] = {}


def built_in_forest(spark: SparkSession) -> str:
    """The forest of ``labelled_findings``, fitted once in a session: those findings never change."""
    session = spark.sparkContext.applicationId
    if session not in _FITTED:
        _FITTED[session] = train_forest(labelled_findings(spark))
    return _FITTED[session]


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> str:
    """Fit a forest to labelled findings and return its probability as SQL over a feature struct ``f``.

    Findings have ``prior``, ``found``, ``next`` and a ``label`` of 0 or 1; null texts count as empty;
    findings without a label or a value teach nothing, repeated ones count each; the order of rows does not
    matter; without findings the fit fails as there is nothing to learn; other columns are ignored.
    """
    array = "array(struct(coalesce(prior, '') AS prior, coalesce(found, '') AS found, coalesce(next, '') AS next, '' AS gap))"
    usable = findings.where("label IS NOT NULL AND coalesce(found, '') <> ''")
    # at most MAX_FINDINGS rows of one order, so that a fit depends neither on partitions nor on their order
    bounded = usable.withColumn("_order", F.xxhash64("prior", "found", "next")).orderBy("_order", "prior", "found", "next", "label").limit(MAX_FINDINGS)
    rows = bounded.coalesce(1).selectExpr("cast(label AS double) AS label", f"{_with_features(array)}[0] AS f").select("label", "f.*")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="6", subsamplingRate=0.8, seed=11).fit(assembled)
    return forest_sql(model)


def forest_sql(model: RandomForestClassificationModel) -> str:
    """A forest of two classes as one SQL expression: the mean of its trees' leaf shares."""
    names = list(FEATURES)

    def walk(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return f"{stats[1] / sum(stats):.9f}D"
        split = node.split()
        return f"CASE WHEN f.{names[split.featureIndex()]} <= {split.threshold()!r}D THEN {walk(node.leftChild())} ELSE {walk(node.rightChild())} END"

    trees = [walk(tree._call_java("rootNode")) for tree in model.trees]
    return f"({' + '.join(trees)}) / {len(trees)}"


def _decided(text: str, forest: str) -> str:
    """SQL: candidates of a text with their probability."""
    found = f"filter({_candidates(text)}, p -> p.found IS NOT NULL)"
    return f"transform({_with_features(found)}, f -> struct(f.gap, f.found, f.vendor > 0 AS vendor, f.named > 0 AS named, {forest} AS probability))"


def _has_candidate(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))


def secret_findings(docs: DataFrame, forest: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate of every whole text: id, ``start`` and ``length`` in characters, ``sha256`` of the
    value, ``kind``, the forest's ``probability`` and ``is_secret``.

    Null and empty texts have none; texts of any length are scanned whole; repeated rows are found each
    time; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text")).where(_has_candidate("_text"))
    each = rows.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), F.expr(_decided("_text", forest)).alias("_found")).select(id_col, "_row", F.posexplode("_found").alias("_at", "_hit"))
    so_far = W.partitionBy("_row").orderBy("_at")
    before = F.sum(F.length("_hit.gap") + F.length("_hit.found")).over(so_far) - F.length("_hit.found")
    return each.select(
        id_col,
        before.cast("long").alias("start"),
        F.length("_hit.found").cast("long").alias("length"),
        F.sha2("_hit.found", 256).alias("sha256"),
        F.when(F.col("_hit.vendor"), "vendor").when(F.col("_hit.named"), "named").otherwise("bare").alias("kind"),
        F.round("_hit.probability", 6).alias("probability"),
        (F.col("_hit.probability") >= LEAST).alias("is_secret"),
    )


def without_secrets(docs: DataFrame, forest: str, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """All rows and columns of ``docs``, with every secret in the text replaced by ``mask``.
    Null texts stay null, empty texts and texts without secrets stay as they are; whole texts of any length
    are scanned; repeated rows are masked alike; an empty table gives no rows."""
    quoted = text_col.replace("`", "``")
    text = f"`{quoted}`"
    decided = _decided(text, forest)
    masked = mask.replace("\\", "\\\\").replace("'", "\\'")
    pattern = CANDIDATE.replace("\\", "\\\\")
    joined = f"concat(array_join(transform({decided}, f -> concat(f.gap, if(f.probability >= {LEAST}, '{masked}', f.found))), ''), element_at(split({text}, '{pattern}', -1), -1))"
    return docs.withColumn(text_col, F.when(_has_candidate(text_col), F.expr(joined)).otherwise(F.col(text_col)))
