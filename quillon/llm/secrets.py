"""Credentials in source code, configuration and chat: finding and redacting them.

1. A keyword automaton (Aho-Corasick, ASCII case folded) picks the lines worth looking at; every rule below asks for
   one of its keywords.
2. On those lines, issuer formats, logins in URLs, connection strings, header and command-line logins, assignments
   to credential names, login calls and what is said of passwords in prose are matched by regular expressions.
3. Each value is validated. Structure decides: heads of web tokens and encoded logins are decoded, access key ids
   must be base32, key bodies and issuer tokens have their length and alphabet, and placeholders, masks, references,
   paths and plain words are dropped. Checksums that issuers put into their tokens are computed and reported (column
   `proof`); a token whose checksum fails is still redacted, as a mistyped or cut one gives away most of a secret.
4. Redaction replaces letters and digits of the value alone, each by one of its kind (A, a, 0), so length,
   quotes, escapes, separators and padding stay. Redacting twice changes nothing.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.materialize import widen

# --- fixed values: usual names of accounts that people share logins of -------------------------------------
USERS = "root admin administrator user guest ops deploy deployer postgres mysql ubuntu oracle sa svc service backup demo test dev build jenkins pi ec2-user vagrant operator support".split()
# --- fixed values: keywords of the automaton -----------------------------------------------------------
KEYWORDS = [
    "pass", "pwd", "kennwort", "contrase", "clave", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "_key", "key", "cred", "auth", "bearer", "basic ", "private key", "://", "sig=", "login", "account", "connect", "signin", "sign_in", "create_user", "createuser", "bind(",
    "akia", "asia", "pw", "mot de", "mdp", "--", " -p", " -u ", "dsn", "license", "aws", "redis-cli",
    "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "glrt-", "gldt-", "glptt-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "xapp-", "hooks.slack", "api/webhooks", "aiza", "ya29.", "gocspx-", "sk_live_", "rk_live_", "sk_test_", "rk_test_", "whsec_", "eyj", "npm_", "sg.", "sk-", "hf_", "dckr_pat_", "pypi-", "dop_v1_", "shpat_", "shpss_", "sq0atp-", "sq0csp-", "dapi", "hvs.", "lin_api_", "ntn_", "glsa_", "nfp_", "pmak-", "nrak-", "age-secret-key-", "atatt3", ":aa",
    *(f"{user}:" for user in USERS),
]
# --- fixed values: issuer formats ----------------------------------------------------------------------
ISSUERS = [
    r"(?:AKIA|ASIA)[A-Z2-7]{16}",
    r"gh[opusr]_[A-Za-z0-9]{36}",
    r"github_pat_[A-Za-z0-9_]{60,}",
    r"glpat-[A-Za-z0-9_-]{20}",
    r"xox[abprs]-[0-9]{8,}-[A-Za-z0-9-]{12,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"npm_[A-Za-z0-9]{36}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{30,}",
    r"sk-(?:proj-|ant-[a-z0-9]+-|or-v1-)?[A-Za-z0-9_-]{32,}", r"hf_[A-Za-z]{34}", r"dckr_pat_[A-Za-z0-9_-]{27}", r"xapp-\d-[A-Z0-9]+-\d+-[a-f0-9]{32,}", r"gl(?:rt|dt|ptt)-[A-Za-z0-9_-]{20,}", r"ya29\.[A-Za-z0-9_-]{30,}", r"GOCSPX-[A-Za-z0-9_-]{28}", r"whsec_[A-Za-z0-9+/=]{24,}", r"pypi-AgE[A-Za-z0-9_-]{50,}", r"dop_v1_[a-f0-9]{64}",
    r"shp(?:at|ss|ca|pa)_[a-fA-F0-9]{32}", r"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}", r"dapi[a-f0-9]{32}(?:-\d)?", r"hvs\.[A-Za-z0-9_-]{24,}", r"lin_api_[A-Za-z0-9]{40}", r"ntn_[A-Za-z0-9]{40,}", r"glsa_[A-Za-z0-9]{32}_[a-f0-9]{8}", r"nfp_[A-Za-z0-9]{36}", r"PMAK-[a-f0-9]{24}-[a-f0-9]{34}", r"NRAK-[A-Z0-9]{27}", r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}", r"ATATT3[A-Za-z0-9_=-]{50,}", r"\d{8,10}:AA[A-Za-z0-9_-]{33}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}",
]
#: How an issuer's token begins, for tokens written in two parts.
ISSUER_START = re.compile(r"(?:AKIA|ASIA|gh[opusr]_|github_pat_|glpat-|xox[abprs]-|AIza|[sr]k_(?:live|test)_|npm_|eyJ|sk-|hf_|dckr_pat_|xapp-|glrt-|ya29\.|GOCSPX-|whsec_|pypi-|dop_v1_|shp[a-z]{2}_|glsa_|hvs\.)")
#: Addresses that are secrets themselves.
HOOK = re.compile(r"https://(?:hooks\.slack\.com/(?:services|workflows)/|(?:\w+\.)?discord(?:app)?\.com/api/webhooks/\d+/|[\w-]+\.webhook\.office\.com/webhookb2/)(?P<v>[\w/@.-]{20,})")
ISSUER = re.compile(r"(?<![A-Za-z0-9_/+=-])(?:" + "|".join(ISSUERS) + r")(?![A-Za-z0-9_-])")
# --- fixed values: names -------------------------------------------------------------------------------
#: Names (letters and digits in lower case) of values that are passwords or phrases.
PASSWORD_NAME = re.compile(r"passw(?:or)?d$|passwort$|passphrase$|pass$|pwd$|kennwort$|contrasena$|motdepasse$|mdp$")
#: Names of keys, tokens and secrets.
KEY_NAME = re.compile(r"(?:secret|token|credentials?|apikey|accesskey|secretkey|signingkey|encryptionkey|licen[sc]ekey|privatekey|masterkey|authkey|servicekey|deploykey|hmackey|sharedkey|jwt|authorization|authheader|proxyauth|auth)$")
# --- fixed values: what a placeholder looks like -------------------------------------------------------
PLACEHOLDER = re.compile(
    r"(?i)[*x.•_\-#]+$|<.*>$|\[.*\]$|\$\{.*|\$\(.*|\$[a-z_]\w*$|\{\{.*|%[a-z_]+%$|#.*|@.*@$|(?:env|vault|file|ref|secret|ssm|op|arn|sops|keyring|config)[:.].*|(?:process|os|system|config|settings)\.\w.*|"
    r".*(?:redacted|replace[-_ ]?me|changeme|change[-_ ](?:me|it)|placeholder|example|not[-_ ]set|your[-_ ]|my[-_](?:secret|token|password|key)|goes[-_ ]here).*|"
    r"(?:.*[^a-z0-9])?(?:dummy|sample|fake|insert|masked|hidden|todo|fixme|tbd)(?:[^a-z0-9].*)?$|"
    r"(?:none|null|nil|undefined|true|false|string|str|secret|password|passwd|token|changeme|test|default|empty|unset|keyword|identifier)$"
)

_NAME = r"(?P<name>[A-Za-z_][\w.\-]*)"
# a name is tried at its beginning only, and what may stand between is bounded, so that no line takes quadratic time
_QUOTED = re.compile(
    r"(?<![\w.\-])" + _NAME + r"""["'`\]\)]*(?:\s*:\s*&?(?:'?static\s+)?[A-Za-z]\w*|\s+string)?\s*(?:\|\|=|\?\?=|:=|=>|=|:)\s*(?:r\#*|b|f)?(?P<q>["'`])(?P<v>(?:(?!(?P=q))[^\n\\]|\\.)+)(?P=q)(?P<more>(?:\s*[+.]\s*["'`][^"'`\n]+["'`])*)"""
)
_BARE = re.compile(r"^[ \t>*+-]*(?:(?:export|set|\#|//|--|;)[ \t]*)*" + _NAME + r"[ \t]*[:=][ \t]*(?P<v>[^\s\"'`].*?)[ \t\r]*$")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://(?P<user>[^\s:/@\"'`<>]*):(?P<v>[^\s/\"'`<>]+)@(?=[\w\[])")
_PAIR = re.compile(r"(?i)(?:^|[;\s\"'`])(?:pwd|password)\s*=\s*(?P<v>[^;\s\"'`]+)\s*;")
_PARAM = re.compile(r"(?i)[?&](?:api_?key|access_?key|access_?token|auth_?token|token|sig|signature|secret|password|key)=(?P<v>[^&\s\"'`#<>]+)")
_HEADER = re.compile(r"(?i)(?:\b(?:proxy-)?authorization|\b(?:x-)?api-key|\bx-auth-token|\bprivate-token|\bx-[a-z]+-token)[\"'`]?\s*[:=]\s*[\"'`]?(?:(?:bearer|token|basic|apikey)\s+)?(?P<v>[A-Za-z0-9_+/=.~\-]{12,})")
_ENCODED = re.compile(r"\b[Bb]asic\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])")
_BEARER = re.compile(r"\b[Bb]earer\s+(?P<v>[A-Za-z0-9_+/.~=\-]{16,})")
#: Commands, and the flag behind them that takes a password.
_COMMANDS = [(re.compile(p), re.compile(f)) for p, f in ((r"\bsshpass\b", r"\s-p\s*[\"'`]?(?P<v>[^\s\"'`]+)"), (r"\blogin\b", r"\s-p\s+[\"'`]?(?P<v>[^\s\"'`]+)"), (r"\bmysql(?:dump|admin)?\b", r"\s-p[\"'`]?(?P<v>[^\s\"'`]+)"), (r"\b(?:curl|wget|http)\b", r"\s(?:-u|--user)\s+[\"'`]?[^\s:\"'`]+:(?P<v>[^\s\"'`]+)"), (r"\bredis-cli\b", r"\s-a\s+[\"'`]?(?P<v>[^\s\"'`]+)"))]
#: A variable set before a command, and an entry of an XML configuration.
_ENV = re.compile(r"(?:^|\s)(?P<name>[A-Z][A-Z0-9_]{2,})=(?P<v>[^\s\"'`]+)(?=\s+\S)")
_XML = re.compile(r"\b(?:key|name)=\"(?P<name>[\w.:\-]+)\"\s+value=\"(?P<v>[^\"\n]+)\"")
_LONG_FLAG = re.compile(r"\s--?(?:password|passwd|passphrase|token|api-key|secret)[ =][\"'`]?(?P<v>[^\s\"'`]+)")
_FLAG = re.compile(r"\s--?(?P<name>[A-Za-z][\w.\-]*)[ =](?:(?P<q>[\"'])(?P<v>[^\"'\n]+)(?P=q)|(?P<w>[^\s\"']+))")
_SAID = re.compile(r"(?i)(?<![\w-])(?:pw|pwd|pass|password|passwd|passphrase|passwort|kennwort|contraseña|mot de passe|api key|token|secret)\s*(?:\bis\b|\bwas\b|\bist\b|\bes\b|\best\b)\s*:?\s*[`\"']?(?P<v>[^\s`\"']{6,})")
_MANIFEST = re.compile(r"(?m)^(?P<pad>[ \t]*)kind:[ \t]*[\"']?Secret[\"']?[ \t]*\r?$")
_ENTRY = re.compile(r"(?m)^[ \t]+[\w.\-]+:[ \t]*[\"']?(?P<v>[A-Za-z0-9+/]{8,}={0,2})[\"']?[ \t]*\r?$")
_NETRC = re.compile(r"\blogin\s+\S+\s+password\s+(?P<v>\S+)")
_NPMRC = re.compile(r":_(?:authToken|password|auth)\s*=\s*[\"']?(?P<v>[^\s\"']+)")
#: Words by which prose speaks of a credential, what may stand right before its value, and account names with one.
_CUE = re.compile(r"(?i)^[\"'`(*]*(?:pw|pwd|pass|pass(?:word|phrase|code|wd)s?|passwort|kennwort|contraseña|clave|mdp|passe|logins?|accounts?|creds?|credentials?|secrets?|tokens?|(?:api[_-]?)?keys?|root|admin)[\"'`:,)*]*$|^[\w.\-]*(?:password|passphrase|secret|token|pass|pwd|key|credentials)[\"'`:,)*]*$")
_LINK = re.compile(r"(?i)^(?:is|was|are|be|uses?|has|to|with|takes?|as|now|ist|lautet|es|est|son|:|=|/|->|=>|→|it's|its)$|.*[:=/]$")
_ACCOUNT = re.compile(r"(?i)^[\"'`(]*(?:" + "|".join(USERS) + r"):(?P<v>[^\s:/\"'`)]{8,})")
#: Calls that take a login: name and password as string literals.
_LOGIN_CALL = re.compile(r"(?i)\b\w*(?:connect|log_?in|authenticate|sign_?in|basic_?auth|credentials?|set_?password|create_?user|add_?user|bind)\w*\s*\((?P<args>[^()\n]*)\)")
_LITERAL = re.compile(r"""(?P<q>["'`])(?P<v>(?:(?!(?P=q))[^\n\\]|\\.)*)(?P=q)""")
_AWS_SECRET = re.compile(r"(?<![A-Za-z0-9/+=_-])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_-])")
_ACCOUNT_KEY = re.compile(r"(?i)\b(?:AccountKey|SharedAccessKey|SharedSecretValue)=(?P<v>[A-Za-z0-9+/]{32,}={0,2})")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,2}PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,2}PRIVATE KEY(?: BLOCK)?-----")
_CONFIG_FILE = re.compile(r"(?i)(?:^|[/\\])(?:\.env[^/\\]*|\.?npmrc|\.?netrc|dockerfile|[^/\\]*\.(?:env|ya?ml|json|toml|ini|cfg|conf|properties|sh|bash|zsh|md|markdown|txt|rst|tf|tfvars|log))$")
_HASH = re.compile(r"(?:sha\d+|md5)[-:]|data:")


def _kinds(v: str) -> int:
    return sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))


def _placeholder(v: str) -> bool:
    return not v or bool(PLACEHOLDER.match(v)) or not re.search(r"[B-Zb-z1-9]", v) or len(set(v)) < 4


def _password(v: str) -> bool:
    """A literal password: no placeholder, no expression, path, word or sentence."""
    if len(v) < 6 or re.search(r"\s", v) or _placeholder(v) or _HASH.match(v) or "://" in v:
        return False
    if re.search(r"[(){}\[\]<>]|\w\.\w+\(|;$|,$", v) or v[0] in "/.~" or re.fullmatch(r"[\w-]+(?:\.[A-Za-z_]\w*)+", v):
        return False
    if re.fullmatch(r"[a-z]+(?:[-_. ][a-z]+)*|[A-Z]+(?:[-_][A-Z]+)*|[a-z]+[A-Z][a-z]+|[A-Z][a-z]+|[0-9.,:-]+", v):
        return False
    return _kinds(v) >= 2


def _key(v: str) -> bool:
    """A literal key or token: long enough and mixed, or of an issuer's format."""
    if ISSUER.fullmatch(v):
        return not _placeholder(v) and _valid_issuer(v)
    if len(v) < 12 or re.search(r"\s", v) or _placeholder(v) or _HASH.match(v) or "://" in v or v[0] in "/.~":
        return False
    if re.search(r"[(){}\[\]<>;,\"'`]", v) or re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", v):
        return False
    return bool(re.search(r"[0-9]", v)) and bool(re.search(r"[A-Za-z]", v)) and len(set(v)) >= 6 or (_kinds(v) >= 2 and len(v) >= 16 and bool(re.search(r"[a-z][A-Z][A-Za-z]*[a-z][A-Z]|[A-Z]{3}[a-z]", v)))


def _valid_issuer(v: str) -> bool:
    if v.startswith("eyJ"):
        try:
            head = v.split(".")[0]
            return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
        except (ValueError, binascii.Error):
            return False
    return "EXAMPLE" not in v and len(set(v)) >= 8


def _spoken(v: str) -> bool:
    """A value that prose can only mean as a password: no word, name, number, path, address or mention of one."""
    if len(v) < 8 or not _password(v) or re.search(r"[/\\]\w+\.\w|^[\w.+-]+@[\w-]+(?:\.[\w-]+)+$|^#|^\d[\d.:-]*\w{0,3}$", v):
        return False
    special = bool(re.search(r"[^A-Za-z0-9_.\-]", v))
    if re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)*\d{0,3}|[A-Z][a-z]+(?:[A-Z][a-z]+)*\d{0,3}|[0-9a-f]+|[A-Za-z]+(?:[-_.][A-Za-z0-9]+)+|[A-Za-z]\w*_\w*", v):
        return False
    # letters alone: case changes more often than in words put together
    mixed = v.isalpha() and len(v) >= 12 and len(v) < 2.3 * len(re.findall(r"[A-Z]?[a-z]*", v)[:-1])
    return special and _kinds(v) >= 3 or _kinds(v) >= 3 and len(v) >= 10 or mixed


def _in_prose(line: str) -> Iterator[tuple[int, int]]:
    """Values that are said to be a password: a cue earlier in the sentence and a link right before, or user:value."""
    cue, last, named = -1, "", ""
    for n, m in enumerate(re.finditer(r"\S+", line)):
        word = m[0]
        pair = _ACCOUNT.match(word)
        if pair:
            v = pair["v"].rstrip(".,;!?") if pair["v"][-1:] in ".,;" else pair["v"]
            if _spoken(v) and (re.search(r"[^A-Za-z0-9]", v) or len(v) >= 12 or _spoken(v)):
                yield m.start() + pair.start("v"), m.start() + pair.start("v") + len(v)
        elif cue >= 0 and (_LINK.match(last) or n - cue == 1):
            bare = word[2:].rstrip(".,;")[:-2] if word.startswith("**") and word.rstrip(".,;").endswith("**") else word
            bare = bare.lstrip("\"'`(").rstrip(".,;").rstrip("\"'`)")
            if _spoken(bare) or (named and _LINK.match(last) and _named(named, bare)):
                start = m.start() + word.index(bare)
                yield start, start + len(bare)
        if _CUE.match(word):
            cue, named = n, re.sub(r"[^\w.\-]", "", word) if re.search(r"_|[a-z][A-Z]|-", word) else ""
        elif word[-1] in ".!?" and not _LINK.match(word):
            cue = -1
        last = word


def _in_calls(line: str) -> Iterator[tuple[int, int]]:
    """The password of a login call: a literal behind the literal name of an account."""
    for m in _LOGIN_CALL.finditer(line):
        said = list(_LITERAL.finditer(m["args"]))
        for name, value in zip(said, said[1:]):
            between = m["args"][name.end() : value.start()].strip()
            if between == "," and re.fullmatch(r"[A-Za-z][\w.@-]*", name["v"]) and _password(value["v"]) and (_kinds(value["v"]) >= 3 or re.search(r"[^A-Za-z0-9_.-]", value["v"])):
                yield m.start("args") + value.start("v"), m.start("args") + value.end("v")


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(width, "0")


def proof(v: str) -> str:
    """What speaks for a value: a checksum that is right or wrong, a structure that can be decoded, or its format alone.

    Tokens gh?_ and npm_ end in the CRC-32 of what stands before in base 62, glsa_ ones in that in base 16.
    """
    if m := re.fullmatch(r"(?:gh[opusr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})", v):
        return "checksum" if _base62(zlib.crc32(m[1].encode()), 6) == m[2] else "checksum fails"
    if m := re.fullmatch(r"glsa_([A-Za-z0-9]{32})_([a-f0-9]{8})", v):
        return "checksum" if f"{zlib.crc32(f'glsa_{m[1]}'.encode()):08x}" == m[2] else "checksum fails"
    if v.startswith("eyJ") and v.count(".") == 2 or re.match(r"(?:AKIA|ASIA)[A-Z2-7]{16}$|-----BEGIN", v) or (len(v) >= 8 and _login(v)):
        return "structure"
    return "format"


def _login(v: str) -> bool:
    """An encoded login: base64 of user:password."""
    try:
        said = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
    except (ValueError, binascii.Error):
        return False
    user, colon, word = said.partition(":")
    return bool(colon and word) and said.isprintable() and not _placeholder(word)


def _named(name: str, v: str) -> bool:
    """Whether `v` is the credential that something called `name` holds."""
    bare = re.sub(r"[^a-z0-9]", "", name.lower().replace("ñ", "n"))
    if PASSWORD_NAME.search(bare):
        return _password(v)
    if KEY_NAME.search(bare):
        scheme, space, rest = v.partition(" ")
        if space and scheme.lower() == "basic":
            return _login(rest.strip())
        if space and scheme.lower() in ("bearer", "token", "apikey"):
            return _key(rest.strip())
        return _key(v) or (len(v) >= 8 and _kinds(v) >= 3 and _password(v))
    return False


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k in KEYWORDS:
        a.add_word(k, len(k))
    a.make_automaton()
    return a


def _lines(text: str) -> list[tuple[int, int]]:
    """Lines (start, end) that hold a keyword."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    out: list[tuple[int, int]] = []
    done = -1
    for end, _ in _automaton().iter(low):
        if end <= done:
            continue
        start = text.rfind("\n", 0, end + 1) + 1
        done = text.find("\n", end)
        done = len(text) if done < 0 else done
        if not out or out[-1][0] != start:
            out.append((start, done))
    return out


def _in_line(line: str, config: bool) -> Iterator[tuple[int, int, str]]:
    for m in ISSUER.finditer(line):
        if _valid_issuer(m[0]) and not _placeholder(m[0]):
            yield *m.span(), "issuer"
    low = line.lower()
    if "://" in line:
        for m in _URL.finditer(line):
            if not _placeholder(m["v"]) and not re.search(r"[{}$(]\w*[})]|^\$", m["v"]):
                yield *m.span("v"), "url"
        for m in _PARAM.finditer(line):
            if _key(m["v"]) or (len(m["v"]) >= 8 and _kinds(m["v"]) >= 3 and _password(m["v"])):
                yield *m.span("v"), "parameter"
    if "pwd" in low or "password" in low:
        for m in _PAIR.finditer(line):
            if _password(m["v"]):
                yield *m.span("v"), "connection"
    if "auth" in low or "api-key" in low or "-token" in low or "basic" in low or "bearer" in low:
        for m in _ENCODED.finditer(line):
            if _login(m["v"]):
                yield *m.span("v"), "login"
        for p in (_HEADER, _BEARER):
            for m in p.finditer(line):
                if m["v"].lower() not in ("basic", "bearer") and _key(m["v"]):
                    yield *m.span("v"), "header"
    for m in _FLAG.finditer(line) if "-" in line else ():
        part = "v" if m["v"] else "w"
        if _named(m["name"], m[part]):
            scheme = re.match(r"(?i)(?:basic|bearer|token|apikey)\s+", m[part])
            yield m.start(part) + (scheme.end() if scheme else 0), m.end(part), "command"
    for m in HOOK.finditer(line) if "://" in line else ():
        if _key(m["v"].rsplit("/", 1)[-1]):
            yield *m.span("v"), "url"
    for m in _ACCOUNT_KEY.finditer(line):
        if not _placeholder(m["v"]):
            yield *m.span("v"), "connection"
    if "aws" in low or "secret" in low or "akia" in low or "asia" in low:
        for m in _AWS_SECRET.finditer(line):
            if _kinds(m[0]) >= 3 and re.search(r"[A-Z]", m[0]) and re.search(r"[a-z]", m[0]) and re.search(r"[0-9]", m[0]) and not _placeholder(m[0]):
                yield *m.span(), "issuer"
    for command, flag in _COMMANDS:
        if m := command.search(line):
            for f in flag.finditer(line, m.end()):
                if _password(f["v"]):
                    yield *f.span("v"), "command"
    for p, rule in ((_SAID, "phrase"), (_LONG_FLAG, "command"), (_NETRC, "netrc"), (_NPMRC, "npmrc")):
        for m in p.finditer(line):
            if _password(m["v"]) and (rule != "phrase" or _kinds(m["v"]) >= 3 or (len(m["v"]) >= 10 and not re.fullmatch(r"[A-Z]?[a-z]+[0-9]*", m["v"]))):
                yield *m.span("v"), rule
    for p in (_ENV, _XML) if "=" in line else ():
        for m in p.finditer(line):
            if _named(m["name"], m["v"]):
                yield *m.span("v"), "assignment"
    for a, b in _in_prose(line):
        yield a, b, "phrase"
    if "(" in line:
        for a, b in _in_calls(line):
            yield a, b, "call"
    for m in _QUOTED.finditer(line):
        v = m["v"]
        parts = re.findall(r"""["'`]([^"'`\n]+)["'`]""", m["more"]) if m["more"] else []
        whole = v + "".join(parts)
        if _named(m["name"], whole) or (parts and ISSUER.fullmatch(whole) and _valid_issuer(whole)):
            scheme = re.match(r"(?i)(?:basic|bearer|token|apikey)\s+", v)
            yield m.start("v") + (scheme.end() if scheme else 0), m.end("v"), "assignment"
            if parts:
                for x in re.finditer(r"""["'`]([^"'`\n]+)["'`]""", m["more"]):
                    yield m.start("more") + x.start(1), m.start("more") + x.end(1), "continued"
    if config:
        m = _BARE.match(line)
        if m:
            v = re.sub(r"\s+#.*$", "", m["v"]).rstrip(",;") if not re.search(r"[#;]\S*$", m["v"]) else m["v"]
            if _named(m["name"], v):
                scheme = re.match(r"(?i)(?:basic|bearer|token|apikey)\s+", v)
                yield m.start("v") + (scheme.end() if scheme else 0), m.start("v") + len(v), "assignment"


def _key_block(text: str, at: int) -> int:
    """End of the key body that follows the BEGIN mark ending at `at`, or -1 if there is none."""
    end = _PEM_END.search(text, at)
    stop = end.start() if end else len(text)
    body = text[at:stop]
    if not end:  # cut off: the body goes on as long as it looks like one
        m = re.match(r"(?:\\[rn]|[\s\"'+,]|[A-Za-z0-9+/=])*", body)
        body = m[0] if m else ""
        stop = at + len(body)
    plain = re.sub(r"\\[rn]|[\s\"'`+,]", "", "" if not body else re.sub(r"(?m)^[A-Za-z-]+: .*$", "", body))
    return stop if len(re.sub(r"[^A-Za-z0-9/=]", "", plain)) >= 40 and len(set(plain)) >= 12 else -1


def _manifest_values(text: str) -> Iterator[tuple[int, int]]:
    """Values in the data block of a secret's manifest: base64 of printable text."""
    for kind in _MANIFEST.finditer(text):
        block = re.compile(r"(?m)^" + kind["pad"] + r"data:[ \t]*\r?\n(?:(?:" + kind["pad"] + r"[ \t]+\S.*)?\r?(?:\n|\Z))+").search(text, kind.end())
        if not block or re.search(r"(?m)^---", text[kind.end() : block.start()]):
            continue
        for m in _ENTRY.finditer(text, block.start(), block.end()):
            try:
                said = base64.b64decode(m["v"], validate=True).decode("utf-8").strip()
            except (ValueError, binascii.Error):
                continue
            if len(said) >= 6 and said.isprintable() and not _placeholder(said) and not re.search(r"\s", said):
                yield m.span("v")


def find_credentials(text: str | None, path: str | None = None) -> list[tuple[int, int, int, str]]:
    """Credentials of a text as (start, end, line from 1, rule), in order and without overlaps.

    A value written in several parts has one entry per part, the later ones with the rule "continued".
    """
    if not text:
        return []
    config = path is None or bool(_CONFIG_FILE.search(path))
    spans: list[tuple[int, int, str]] = []
    blocks: list[tuple[int, int]] = []
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            stop = _key_block(text, m.end())
            if stop > 0:
                blocks.append((m.start(), stop))
                spans.append((m.start(), stop, "private key"))
    if "Secret" in text:
        spans += [(a, b, "manifest") for a, b in _manifest_values(text)]
    for start, end in _lines(text):
        for a, b, rule in _in_line(text[start:end], config):
            spans.append((start + a, start + b, rule))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, int, str]] = []
    last, line, at = -1, 1, 0
    for a, b, rule in spans:
        if a < last:
            continue
        line += text.count("\n", at, a)
        at, last = a, b
        out.append((a, b, line, rule))
    return out


def redact(text: str | None, path: str | None = None) -> str | None:
    """The text with every letter and digit of its credentials replaced by one of its kind."""
    found = find_credentials(text, path)
    if not found or text is None:
        return text
    out, at = [], 0
    for a, b, _, rule in found:
        if rule == "private key":
            a = text.index("-----", a + 5) + 5
        value = re.sub(r"\\.|[A-Z]|[a-z]|[0-9]|[^\W\d_]", lambda m: m[0] if m[0][0] == "\\" else "A" if m[0].isupper() else "0" if m[0].isdigit() else "a", text[a:b])
        out += [text[at:a], value]
        at = b
    return "".join(out) + text[at:]


def credentials(rows: DataFrame, item: str = "id", text: str = "text", path: str = "path") -> DataFrame:
    """One row per credential: `item`, lineNo, startChar, length, rule, proof.

    `lineNo` counts from 1 at every newline; for a private key it is the line of its BEGIN mark. Characters
    are code points. Rows with a null or empty text have no row; a null path counts as chat. Repeated rows
    give the same credentials again. Whole texts are read, however long.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, line, a, b - a, rule, proof(t[a:b])) for i, t, p in zip(batch["i"], batch["t"], batch["p"]) for a, b, line, rule in find_credentials(t, p) if rule != "continued"]
            yield pd.DataFrame(out, columns=["i", "lineNo", "startChar", "length", "rule", "proof"])

    texts = rows.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"), F.col(path).alias("p")).where("t IS NOT NULL AND t <> ''")
    return widen(texts).mapInPandas(run, "i string, lineNo long, startChar long, length long, rule string, proof string").withColumnRenamed("i", item)


def redacted(rows: DataFrame, item: str = "id", text: str = "text", path: str = "path") -> DataFrame:
    """Every row's `item`, its `text` without credentials, and how many there were: `item`, `text`, n_redacted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [sum(rule != "continued" for *_, rule in find_credentials(t, p)) for t, p in zip(batch["t"], batch["p"])]
            yield pd.DataFrame({"i": batch["i"], "t": [redact(t, p) if k else t for t, p, k in zip(batch["t"], batch["p"], n)], "n": n})

    texts = rows.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"), F.col(path).alias("p"))
    return widen(texts).mapInPandas(run, "i string, t string, n int").select(F.col("i").alias(item), F.col("t").alias(text), F.col("n").alias("n_redacted"))
