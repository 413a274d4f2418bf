"""The lexer on planted source and configuration text, and its time on long runs."""

import hashlib
import random
import re
import time

import pytest

secrets = pytest.importorskip("cellgauge.llm.secrets")

HIDDEN = "Zx81Qw77Lp02"
PLANTED = [
    f'KEY_V2 = "{HIDDEN}"\npwd = KEY_V2\n',
    f'K1 = "{HIDDEN}"\nk2 = K1\nauthToken = k2\n',
    f'class C:\n    SALT_9 = "{HIDDEN}"\ndb_pwd = C.SALT_9\n',
    f'export A1="{HIDDEN}"\nPWD=${{A1}}\n',
    f'db_pwd: str = "{HIDDEN}"\n',
    f"DB_PWD={HIDDEN}\n",
    f'pwd = """\n{HIDDEN}\n"""\n',
    f"pwd = '''{HIDDEN}'''\n",
    f"db:\n  pwd: |\n    {HIDDEN}\n  port: 1\n",
    f"<config><userPwd>{HIDDEN}</userPwd></config>",
    f'<entry key="db.pwd">{HIDDEN}</entry>',
    f'<add key="dbPwd" value="{HIDDEN}"/>',
    f'{{"password": {{"value": "{HIDDEN}"}}, "host": "h"}}',
    f'{{"env": [{{"name": "DB_PWD", "value": "{HIDDEN}"}}]}}',
    f"- name: DB_PWD\n  value: {HIDDEN}\n",
    f"pwd:\n  value: {HIDDEN}\n",
    f'os.environ["DB_PWD"] = "{HIDDEN}"',
    f"'pwd' => '{HIDDEN}',",
    f'passphrase := "{HIDDEN}"',
    f'pwd = "{HIDDEN[:5]}" + "{HIDDEN[5:]}"',
]
CLEAN = [
    f'colour = "{HIDDEN}"', f'K = "{HIDDEN}"\nname = K', 'pwd = "changeme"', "pwd = os.getenv(NAME)", "the key: something else", "pwd = other.thing", 'pwd = "<your password>"',
    'pwd = "two words"', "pwd = ''", "author: Somebody1 wrote", f'{{"name": "x", "value": "{HIDDEN}"}}', "pwd == expected1", "tokens: 128000", 'pwd: ""', f"<a>{HIDDEN}</a>",
]


@pytest.mark.parametrize("text", PLANTED)
def test_found(text):
    found = [text[a:b] for a, _, b in secrets.lexed_spans(text, secrets.base_spans(text))]
    assert [re.sub(r'"[ +]*"', "", x) for x in found] == [HIDDEN] or any(HIDDEN in text[a:b] for a, _, b in secrets.base_spans(text)), found
    padded = "é🙂 some prose\n" + text
    assert [padded[a:b] for a, _, b in secrets.lexed_spans(padded, secrets.base_spans(padded))] == found


@pytest.mark.parametrize("text", CLEAN)
def test_left_alone(text):
    assert secrets.lexed_spans(text, []) == []


N = 1_000_000


@pytest.mark.parametrize(
    "unit",
    ["a", "A1", "a =", "key", "key ", "key=", 'key="', "key='", 'pwd="""', "pwd:\n", "pwd: |\n", " ", "key[", "{", "}", "<", "<key>", "<key ", '"', "\\\"", "key.", "key-", "a:", "pwd: int ", "$", "${pwd}", "pwd = x + ", "pwd=pwd1\n"],
)
def test_linear(unit):
    text = "pwd = " + unit * (N // len(unit)) + " ="
    start = time.perf_counter()
    secrets.lexed_spans(text, secrets.base_spans(text))
    assert time.perf_counter() - start < 1


def test_chain_is_linear():
    text = "".join(f"key{i}_token = key{i + 1}_token\n" for i in range(30_000)) + f'key30000_token = "{HIDDEN}"\n'
    start = time.perf_counter()
    found = secrets.lexed_spans(text, [])
    assert time.perf_counter() - start < 2 and [text[a:b] for a, _, b in found] == [HIDDEN]


def test_query_columns(spark, tmp_path):
    """All columns of the query against the plain patterns, on a corpus with planted literals, nulls, long and repeated rows."""
    from cellgauge.llm.queries import op8_secret_scan

    r = random.Random(8)
    words = "alpha beta the token is api_key here AKIA secret of".split()
    texts = [None, "", "x" * 300_000]
    for i in range(200):
        t = " ".join(r.choice(words) for _ in range(r.randrange(50)))
        if i % 3 == 0:
            t += "\n" + r.choice(PLANTED)
        if i % 4 == 0:
            t += f'\n{r.choice(["token", "API_KEY", "passwd"])} = "{r.randbytes(r.randrange(2, 20)).hex()}"\nAKIA{"B" * r.randrange(10, 20)}'
        texts.append(t)
    rows = [(i, t, "s", "b") for i, t in enumerate(texts)] + [(7, texts[7], "s", "b")] * 2
    spark.createDataFrame(rows, "doc_id long, text string, spans string, base string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_secret_scan(spark, str(tmp_path)).collect()
    plain = [("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)]
    order, literals = ["assign", "access", "hex", "literal"], 0
    assert sorted(x["doc_id"] for x in got) == sorted(r[0] for r in rows)
    for x in got:
        t = texts[x["doc_id"]] or ""
        want = sorted((m.start(), order.index(k), m.end()) for k, p, least, g in plain for m in re.finditer(p, t) if len(m[g]) >= least)
        text = ",".join(f"{order[k]}:{a}:{b}" for a, k, b in want)
        assert x["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        spans = [(int(a), order.index(k), int(b)) for k, a, b in (s.split(":") for s in x["spans"].split(",") if s)]
        assert spans == sorted(spans) and [s for s in spans if s[1] < 3] == want
        literals += sum(s[1] == 3 for s in spans)
    assert literals > 40
