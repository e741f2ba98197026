"""Credentials embedded in source code, configuration and request bodies.

A line is lexed into tokens with their offsets; a linear-chain CRF labels each token as
other, secret or user name from its shape (character classes, length, entropy, prefix,
placeholder words) and its context (the key or scheme words before it, separators,
quotes, calls).  The Viterbi path says which characters are taken out: exactly the
tokens labelled secret, so quotes, names and scheme words stay and the code around them
still parses.

The CRF is trained here, on lines written from the templates below with generated
values; their number is the parameter ``TRAINING_LINES``.  No row of the data is used.

Every line is decoded.  What the model sees of a token is its class: shape, kind of name,
sign or known word.  Lines of the same classes have the same labels, so a line is lexed,
its classes looked up, and only a sequence of classes not met before goes through Viterbi.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import jsontext
from tracewright.llm import crf
from tracewright.session import spread

LABELS = ("other", "secret", "user")
OTHER, SECRET, USER = range(3)

#: Lines written for training.
TRAINING_LINES = 9000
#: What a secret is replaced with; it is a plain word, so it fits every syntax.
REDACTED = "REDACTED"
#: Lines decoded at a time; how many lines, tokens and class sequences keep their result (memory only).
BATCH_LINES = 2000
CACHE_LINES = 100_000
CACHE_TOKENS = 500_000
CACHE_SEQUENCES = 200_000

# ---------------------------------------------------------------- lexer

_PEM = r"-----BEGIN (?P<pem>[A-Z0-9 ]+)-----.*?-----END (?P=pem)-----"
_TOKEN = re.compile(
    rf"(?P<block>{_PEM})"
    r"|(?P<code>[A-Za-z0-9+/]{16,}={1,2}(?![A-Za-z0-9=]))"  # base64 with its padding
    r"|(?P<slash>/{2,})"
    r"|(?P<word>[A-Za-z0-9_!#$%*?&^~+/.\-]*[A-Za-z0-9_!#$%*?&^~+/\-])"
    r"|(?P<wide>[^\x00-\x7f]+)"
    r"|(?P<mark>[^\sA-Za-z0-9])",
    re.S,
)


def lex(line: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of a line, in order; white space is skipped."""
    out = []
    for m in _TOKEN.finditer(line):
        a, b, t = m.start(), m.end(), m.group()
        # a reference such as $NAME, ${..} or %s begins with its sign; #, & and // open comments
        if m.lastgroup == "word" and len(t) > 1 and t[0] in "$&#" and (t[1:].isidentifier() or not any(map(str.isalnum, t))):
            out.append((a, a + 1, t[0]))
            a, t = a + 1, t[1:]
        if "&" in t and line[b : b + 1] == "=" and (cut := t.rfind("&")) > 0 and t[cut + 1 :].isidentifier():  # the next parameter of a query
            out += [(a, a + cut, t[:cut]), (a + cut, a + cut + 1, "&")]
            a, t = a + cut + 1, t[cut + 1 :]
        out.append((a, b, t))
    return out


# ---------------------------------------------------------------- features

#: Words that make a name the name of a secret, by kind.
KEY_WORDS = {
    "pass": ("password", "passwd", "passphrase", "passwort", "passcode", "pwd", "pw", "pass", "kennwort", "contraseña", "clave", "密碼", "密码"),
    "secret": ("secret", "credential", "signing", "salt"),
    "token": ("token", "jwt", "pat"),
    "key": ("apikey", "accesskey", "secretkey", "privatekey", "servicekey", "key"),
    "auth": ("authorization", "auth", "bearer", "basic"),
    "user": ("username", "user", "login", "account", "uid", "usr"),
}
#: Words that stand for a value which is not there.
PLACEHOLDERS = (
    "masked", "redacted", "todo", "tbd", "insert", "your", "changeme", "change", "example", "placeholder", "dummy", "none", "null",
    "string", "here", "fill", "xxxx", "undefined", "empty", "sample", "replace", "hidden", "removed", "secret", "password", "token",
    "account", "username", "key", "passwd", "pwd", "user",
)
#: Names of things that look like secrets and are none.
DIGEST_WORDS = ("sha256", "sha512", "sha1", "md5", "integrity", "etag", "commit", "digest", "checksum", "hash", "uuid", "base64", "src", "id", "fingerprint", "revision", "version", "image", "path", "file", "public", "cert", "certificate")
_PREFIX = re.compile(r"^(?:sk|pk|rk|key|tok|pat|ghp|gho|ghs|glpat|xox[abp]|akia|asia|aiza|npm|pypi|api|live|eyj)[-_]?(?=[A-Za-z0-9])", re.I)
_HEX = re.compile(r"^[0-9a-f]+$|^[0-9A-F]+$")
_UUID = re.compile(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\x00-\x7f]+|\d+")


def _entropy(t: str) -> float:
    n = len(t)
    return -sum(c / n * math.log2(c / n) for c in (t.count(x) for x in set(t)))


_HOLDERS = frozenset(PLACEHOLDERS)
#: Forms that are told apart by nothing but their form: words, names, numbers, paths.
_SIMPLE = re.compile(
    r"(?P<plain>[A-Z]?[a-z]+)|(?P<camel>[a-z]+(?:[A-Z][a-z]*)+|(?:[A-Z][a-z]+){2,})|(?P<number>\d+(?:[.\-/:]\d+)*)|(?P<const>[A-Z]+(?:_[A-Z]+)*)"
    r"|(?P<dotted>[A-Za-z_]+(?:\.[A-Za-z_]+)+)|(?P<snake>[a-z]+(?:_[a-z]+)+)|(?P<kebab>[a-z]+(?:-[a-z]+)+)|(?P<path>/?[A-Za-z]+(?:[/.][A-Za-z]+)*(?:/\d+)?)"
)
_SEPARATORS = re.compile(r"[-_./]+")
_SEPARATED = re.compile(r"[A-Za-z0-9]+(?:[-_./+]+[A-Za-z0-9]+)+")


def _length(n: int) -> str:
    return "len=" + ("-4" if n < 5 else "5-8" if n < 9 else "9-12" if n < 13 else "13-20" if n < 21 else "21-31" if n < 32 else "32-47" if n < 48 else "48+")


def shape(t: str) -> tuple[str, ...]:
    """Features of a token by itself."""
    if t.startswith("-----BEGIN"):
        kind = "private" if "PRIVATE" in t[:60] else "open"
        return (f"block={kind}", "s=block")
    if len(t) == 1 and not t.isalnum():
        return (f"mark={t}", "s=mark")
    m = _SIMPLE.fullmatch(t)
    if m:
        low = t.lower()
        held = low in _HOLDERS if m.lastgroup == "plain" else any(w in _HOLDERS for w in _SEPARATORS.split(low)) or not low.strip("x")
        # letters alone can be a secret where they are long and of mixed case
        loose = m.lastgroup == "camel" and len(t) >= 8 and sum(map(str.isupper, t)) * (3 if len(t) < 16 else 4) >= len(t)
        return (f"s={m.lastgroup}", *(("s+=loose", _length(len(t))) if loose else ()), *(("placeholder",) if held else ()))
    if not t.isascii():
        return ("s=wide",)
    low = t.lower()
    n = len(t)
    digits = sum(map(str.isdigit, t))
    upper = sum(map(str.isupper, t))
    lower = sum(map(str.islower, t))
    special = n - digits - upper - lower
    ent = _entropy(t)
    if not digits + upper + lower:
        form = "signs"
    elif _UUID.match(t):
        form = "uuid"
    elif n >= 16 and _HEX.match(t):
        form = "hex"
    elif n >= 17 and digits and _HEX.match(t[1:]):
        form = "hex1"
    elif t.startswith("eyJ") and re.fullmatch(r"eyJ[\w\-]+\.[\w\-]+\.[\w\-]+", t):
        form = "jwt"
    elif n >= 16 and digits and upper and lower and ent > 3.4:
        form = "random"
    elif special and not _SEPARATED.fullmatch(t):
        form = "strong" if digits and upper + lower else "signed"
    elif special and digits and lower:
        form = "parts"  # words and numbers with separators
    elif digits and upper + lower:
        form = "mixed"
    else:
        form = "rest"
    out = [f"s={form}", _length(n), "kinds=" + ("d" if digits else "") + ("u" if upper else "") + ("l" if lower else "") + ("s" if special else "")]
    if n >= 9:
        out.append(f"ent={min(5, int(ent))}")
    if n >= 16 and _PREFIX.match(t):
        out.append("prefix")
    if set(low) <= set("x*.-_") or any(w in _HOLDERS for w in re.split(r"[^a-z]+", low) if w):
        out.append("placeholder")
    return tuple(out)


_KIND_OF = {w: k for k, ws in KEY_WORDS.items() for w in ws}
_WITHIN = re.compile("|".join(re.escape(w) for w in sorted(_KIND_OF, key=len, reverse=True) if len(w) > 4 or not w.isascii()))
_DIGESTS = frozenset(DIGEST_WORDS)


def key_kinds(t: str) -> tuple[str, ...]:
    """Which kinds of secret a name speaks of; ``plain`` for other words."""
    if t.startswith("-----") or not any(map(str.isalpha, t)):
        return ()
    words = [w.lower() for w in _WORDS.findall(t)]
    kinds = {_KIND_OF[w] for w in words if w in _KIND_OF}
    joined = "".join(words)
    if _WITHIN.search(joined):
        kinds |= {k for w, k in _KIND_OF.items() if (len(w) > 4 or not w.isascii()) and w in joined}
    if not _DIGESTS.isdisjoint(words):
        kinds.add("digest")
    return tuple(sorted(kinds)) or ("plain",)


class TokenClass(NamedTuple):
    """All that the model sees of a token."""

    shape: tuple[str, ...]
    kinds: tuple[str, ...]
    #: The sign itself, ``w`` for any other token.
    sign: str
    #: The token in small letters if the model knows it as a word.
    word: str
    slashes: bool


def token_class(t: str, known: Callable[[str], bool] | None = None) -> TokenClass:
    own = shape(t)
    mark = own[-1] == "s=mark"
    word = t.lower() if not mark and len(t) < 16 else ""
    if word and known is not None and not known(f"w1={word}"):
        word = ""
    return TokenClass(own, () if mark else key_kinds(t), t if len(t) == 1 and not t.isalnum() else "w", word, t == "//")


_STRONG = {"s=strong", "s=random", "s=jwt", "s=mixed", "s=hex", "s=hex1", "s+=loose"}


def features(tokens: list[str], body: bool = False) -> list[list[str]]:
    """Feature names of each token of a line; see :func:`class_features`."""
    return class_features([token_class(t) for t in tokens], body)


def class_features(line: Sequence[TokenClass], body: bool = False) -> list[list[str]]:
    """Feature names of each token: shape, names before it, separators, quotes, what follows.

    ``body``: the tokens are keys and values of a request body, where user names count too.
    """
    n = len(line)
    out: list[list[str]] = []
    names: list[int] = []
    line_kinds = sorted({k for c in line for k in c.kinds if k != "plain"})
    slashes = False
    for i, c in enumerate(line):
        own = c.shape
        main = next((x for x in own if x.startswith(("s=", "block="))), "")
        f = ["bias", *own]
        before = line[i - 1] if i else None
        if own[-1] == "s=mark":
            f.append("p=" + (before.sign if before and before.sign != "w" else "_"))
            out.append(f)
            slashes = slashes or c.slashes
            continue
        p1 = before.sign if before else "w"
        p2 = line[i - 2].sign if i > 1 else "w"
        n1 = line[i + 1].sign if i + 1 < n else "$"
        if before is None:
            p1, p2 = "^", "^"
        f += [f"p1={p1}", f"p2={p2}{p1}", f"n1={n1}", f"p1n1={p1}{n1}"]
        hard = "hard" if not _STRONG.isdisjoint(own) else "soft"
        holder = "placeholder" in own
        f += [f"hard={hard}", f"{main}|{p1}", f"{main}|{n1}", f"{main}|{p1}{n1}"]
        if names:
            last = line[names[-1]]
            gap = "".join("." if x.sign == "w" else x.sign for x in line[names[-1] + 1 : i])[-4:]
            f.append(f"gap={gap}")
            for k in last.kinds:
                f += [f"k1={k}", f"k1={k}|{main}", f"k1={k}|{gap}", f"k1={k}|{hard}|{n1}", f"k1={k}|ph={holder}"]
                if body:
                    f += [f"body|k1={k}|{gap}", f"body|k1={k}|ph={holder}"]
            for k in line[names[-2]].kinds if len(names) > 1 else ():
                f += [f"k2={k}", f"k2={k}|{main}"]
            if last.word:
                f.append(f"w1={last.word}")
            called = names[-1] + 1 < n and line[names[-1] + 1].sign == "("
            f.append(f"arg={called}|{main}")
        else:
            f.append(f"first|{main}")
        for k in line_kinds:
            f += [f"line={k}", f"line={k}|{main}"]
        if not line_kinds:
            f.append(f"line=none|{main}")
        if slashes and p1 == ":" and n1 == "@":
            f.append("url-password")
        if slashes and n1 == ":" and before and before.slashes:
            f.append("url-user")
        if n1 in ("(", "[", "."):
            f.append("called")
        if holder:
            f.append(f"ph|{p1}{n1}")
        f.append("own-kind=" + "+".join(c.kinds))
        names.append(i)
        slashes = slashes or c.slashes
        out.append(f)
    return out


# ---------------------------------------------------------------- training lines

_SYLLABLES = ("ba", "cor", "den", "fil", "gar", "hol", "jin", "kel", "lum", "mor", "nes", "pol", "qui", "ras", "sol", "tam", "ur", "vel", "win", "zan")
_ALNUM = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"

#: {S} secret, {U} user of no password of its own, {W} word, {C} constant, {V} variable, {T} type,
#: {H} hex digest, {B} base64 that is no secret, {P} placeholder or reference, {N} number.
_SECRET_LINES = (
    "{w}.{w}.password={S}", "{w}.datasource.{w}.password={S}", "{w}.password = {S}", "password: {S}", "  password: \"{S}\"", "{C}_PASSWORD={S}", "{C}_PASS='{S}'",
    "export {C}_PASSWORD='{S}'", "export {C}_PWD=\"{S}\"", "export {C}_PASSWD={S}", "ENV {C}_PASSWORD {S}", "ENV {C}_PASS {S}", "ENV {C}_PW {S}", "{C}_PW={S}", "pw: {S}", "set {C}_PWD={S}", "ARG {C}_SECRET={S}",
    "<property name=\"password\" value=\"{S}\"/>", "<property name=\"{w}.password\" value=\"{S}\" />", "<password>{S}</password>", "<entry key=\"{w}.password\">{S}</entry>",
    "url: jdbc:postgresql://{U}:{S}@{w}{N}.{w}.invalid:{N}/{w}", "{V} = \"mysql://{U}:{S}@{w}.{w}.org/{w}\"", "amqp://{U}:{S}@{w}:{N}", "redis://{U}:{S}@{w}.{w}:{N}/0", "mongodb://{U}:{S}@{w}.{w}/{w}", "https://{U}:{S}@{w}.{w}.net/{w}.git",
    "{V} = \"Server={w}.{w}.invalid;Uid={w};Pwd={S};Timeout={N}\"", "{V} = \"Host={w};User Id={w};Password={S};\"", "dsn = \"host={w} user={w} password={S} dbname={w}\"",
    "        {V}.setPassword(\"{S}\");", "{V}.set_password('{S}')", "{V}.login(\"{w}\", \"{S}\")", "{V} = connect(user=\"{w}\", password=\"{S}\")", "auth=('{w}', '{S}')", "String password = \"{S}\";", "password = '{S}'", "passwd = \"{S}\"", "const password = \"{S}\";",
    "ALTER USER {w} WITH PASSWORD '{S}';", "CREATE USER {w} IDENTIFIED BY '{S}';", "CREATE ROLE {w} LOGIN PASSWORD '{S}';", "mysql -u {w} -p{w} --password={S}", "curl -u {U}:{S} https://{w}.{w}/{w}",
    "# log in as {w} with {S} on the {w} box", "// sign in as {w} with {S} until {w}", "# the password of {w} is {S}", "the login is {w} and the password is {S}", "# use {S} as password for {w}", "# {w} / {S} logs in on {w}", "# login {w} with {S}",
    "String {w} = \"{X}\";", "{V} = '{X}'", "{V} = (\"{w}\", \"{X}\")", "{V}('{w}', '{w}', '{X}')", "{V}(\"{w}\", \"{X}\")", "{V}: {X}", "{w} {w}: {X}", "密碼: {S}", "// 密碼是 {S}", "# {w} 的密碼：{S}", "// 登入密碼為 {S}", "預設密碼 {S}", "// 系統密码是 {S}", "密钥: {X}", "密鑰：{X}", "passwort: {S}", "contraseña: {S}", "mot de passe: {X}", "{w}={X}",
    "{\"username\": \"{w}{N}\", \"password\": \"{S}\"}", "{\"user\": \"{w}\", \"pwd\": \"{S}\", \"remember\": false}", "  \"password\": \"{S}\",",
)
_TOKEN_LINES = (
    "x-api-key: {S}", "X-Auth-Token: {S}", "api_key = \"{S}\"", "apiKey: {S}", "\"apiKey\": \"{S}\",", "{C}_API_KEY={S}", "export {C}_TOKEN={S}", "token: \"{S}\"", "token = '{S}'",
    "    private static final String {C}_KEY = \"{S}\";", "    private static final String API_KEY = \"{S}\";", "public static final String {C}_SECRET = \"{S}\";", "static final String {C}_TOKEN = \"{S}\";",
    "{w}.secret_access_key = \"{S}\"", "aws_secret_access_key = {S}", "  secret-key: {S}", "  signing-secret: {S}", "  {w}-secret: {S}", "  jwtSecret: {S}", "  client-secret: {S}", "secret: {S}", "{w}.jwt.secret={S}",
    "{\"clientId\": \"{w}-app\", \"clientSecret\": \"{S}\"}", "{\"client_id\": \"{w}\", \"client_secret\": \"{S}\"}", "\"accessToken\": \"{S}\"", "\"serviceKey\": \"{S}\"",
    "curl -H \"Authorization: Bearer {S}\" https://{w}.{w}.invalid/{w}", "Authorization: Bearer {S}", "headers.put(\"Authorization\", \"Bearer {S}\");", "{V}.header('Authorization', 'token {S}')",
    "        {V}.init(\"{S}\");", "{w}.init(\"{S}\");", "{w}.connect('{S}')", "{V} = {T}(token=\"{S}\", timeout={N})", "{V} = {T}(api_key='{S}')", "{V}.withToken(\"{S}\")", "{V}.configure(\"{S}\")", "{V} = {T}(\"{S}\")", "{w}.setApiKey(\"{S}\");", "stripe.api_key = '{S}'",
    "# token for {w}: {S}", "webhook_secret={S}", "access_token={S}&state={w}",
)
_BASIC_LINES = ("headers.put(\"Authorization\", \"Basic {S}\");", "Authorization: Basic {S}", "curl -H \"Authorization: Basic {S}\" https://{w}.{w}/{w}", "{V}.set('Authorization', 'Basic {S}')")
_BLOCK_LINES = ("{S}", "\"{w}Key\": \"{S}\"", "private_key: {S}", "{\"private_key\": \"{S}\", \"type\": \"{w}\"}", "{V} = '''{S}'''")
_CLEAN_LINES = (
    "{w}.password={P}", "{w}.mail.password={P}", "password: {P}", "  password: \"{P}\"", "db.password = \"\"", "token: \"{P}\"", "token: {P}", "api_key = \"{P}\"", "secret: {P}", "  secret-key: {P}", "export {C}_TOKEN={P}", "export {C}_PASSWORD='{P}'", "ENV {C}_PASSWORD {P}", "ENV {C}_PW {P}",
    "Authorization: Bearer {P}", "curl -H \"Authorization: Bearer {P}\" https://{w}.{w}/{w}", "url: jdbc:postgresql://{w}:{P}@{w}.{w}:{N}/{w}", "{\"username\": {P}, \"password\": {P}}", "{\"username\": \"{P}\", \"password\": \"{P}\"}", "x-api-key: {P}", "<property name=\"password\" value=\"{P}\"/>",
    "secret = getpass.getpass(\"{w} secret: \")", "password = input(\"{w} password: \")", "api_key = os.environ[\"{C}_API_KEY\"]", "token = os.getenv('{C}_TOKEN')", "String token = System.getenv(\"{C}_TOKEN\");", "password = config.get(\"{w}.password\")",
    "        String password = {V}.getPassword();", "        return {V}.verify({V}, {V}.getPasswordDigest());", "if (password == null || {V}.isEmpty()) { return {V}; }", "{V}.setPassword(password);", "{V}.setToken({V}.{V}());", "check(password.isEmpty(), \"{w}-{N}\", {V});", "return {V}.checkPassword(password, {V});",
    "private-key-path: /etc/{w}/{w}.pem", "ssl.keystore.password.file=/run/{w}/{w}", "key: {w}", "primary_key = {w}_id", "    key: {w}-{w}", "sort_key={w}", "{V} = sorted({V}, key=lambda x: x.{V})", "    {T} tokens = {V}.{V}({V}, {N});", "int token{T} = {N} + {V}.{V}Token();", "{T} {V}Key = {V}.{V}Secret({V}, {N});", "token.append({N})", "tokens = {V}.split({w})", "for token in {V}({V}):", "        for ({T} token : {V}.{V}()) { {V}.add({N}); }", "        for ({T} {V} : token.{V}()) { {V}.add({N}); }", "    public {T} {V}({T} token, int {V}) {", "        {V} = token.stream().filter(x -> x.{V}() > {N}).toList();", "    public {T} {V}({T} password{T}, int {V}) {", "        return {T}.ok(secret{T}.{V}({V}));", "        {V}.set{T}(token{T}.get{T}());", "        {V}(password{T}, {V}, \"{w}/{w}/{N}\");",
    "// password must have at least {N} characters, {w}", "# the token expires after {N} days", "// never log the password of {w}", "the password of {w} was reset by {w}", "lost the password, please call {w}", "the secret of {w} is kept elsewhere", "// see the login page of {w}, step {N}", "密碼不可為空", "請重設密碼", "// 密碼長度不足，錯誤 {N}", "// 密碼至少 {N} 碼", "# 密碼錯誤次數 {N}", "// 密碼檢查見 {V}", "由於密碼在第{N}次檢查時過期，請見`{V}`。", "密码已过期，代码 {N}", "{V}Token / {V}", "{V} / {V}Key", "{V} / {V}", "{V}Secret -> {V}, {V}", "        {V}({V}, tokens, \"{w}/{w}/{N}\");", "        {V}(token, {V}, \"{w}/{w}/{N}\");", "        {V}({V}Token, {V}, \"{w}/{w}/{N}\");", "Please reset the password of `{V}` first", "bitte das passwort von {w} ändern", "cambia la contraseña de `{V}`",
    "image: {w}@sha256:{H}", "integrity: sha512-{B}", "etag: \"{H}\"", "commit {H}", "request-id: {G}", "sha256: {H}", "md5 = \"{H}\"", "<img src=\"data:image/png;base64,{B}\"/>", "checksum={H}", "\"id\": \"{G}\"", "trace_id: {H}", "fingerprint: {H}", "ETag: \"{H}\"", "\"hash\": \"{B}\"", "digest: {B}", "revision = {H}", "{V} = UUID(\"{G}\")",
    "        // {w} {w} before {V}, see {N}", "        log.info(\"{V} {w} {}\", {V}.size());", "        check({V}.isEmpty(), \"{w}-{N}\", {V});", "        {V}({V}, {V}, \"{w}/{w}/{N}\");", "    public {T} {V}({T} {V}, int {V}) {", "        {T} {V} = {V}.{V}({V}, {N});", "GET /api/{w}/{V} -> {V}, {V}", "import app.{w}.{T};", "package app.{w}.{w};", "logger.info('{v} %s', {w})", "{V}.update({'{w}': {v}({w})})", "raise LookupError('{w} {N}')", "        {V}.set{T}({V}.get{T}());", "        return {T}.ok({V}.{V}({V}));",
    "{N}:{N}:{N}.{N} INFO [{w}-{N}] {T}.{V}: {w} {N}", "{N}:{N}:{N}.{N} ERROR [{w}-{N}] {T}.{V}: {w} {N}", "{\"links\": [{\"producer\": \"{V}\", \"consumer\": \"{V}\", \"field\": \"{w}\"}]}", "clientId: {w}-app", "user: {w}", "username={w}{N}", "\"keyId\": \"{w}{N}\"", "public_key: {B}", "ssh-rsa {B} {w}@{w}", "return {T}.ok({V}.{V}Token({V}));", "[{w} {V}Token]", "{K}", "\"cert\": \"{K}\"", "publicKey = \"{K}\"",
    "{\"kind\": \"{N}/{w}/{C}\", \"code\": \"{R}\", \"comment\": \"lost the password, please call {w}\"}", "{\"id\": \"{N}\", \"score\": \"{N}\"}", "{\"kind\": \"{w}\", \"code\": \"{R}\", \"comment\": null}",
    "{w} the {w} of `{V}` {w} in step {N}, so {w} {w} again.", "`{V}` {w} {w} {w}; see {w}{N}.txt and {w}/{w}.java", "| {w} | {N} | {V} | {w}-{N} |", "- {w} {w} ({N} {w}): `{V}`", "## {T} {N}.{N}", "mail {w}{N}@{w}.{w}.invalid about {w}", "{w}.{w}@{w}.{w}", "https://{w}.{w}.{w}/{w}/{N}?{w}={w}&{w}={N}", "經過{N}輪{w}，`{V}`已經穩定。", "在第{N}次執行時，`{V}`的結果不一致", "Nach {N} Schritten bleibt `{V}` bei {w} stehen.", "Después de {N} pruebas, `{V}` devuelve {w}.",
    "def {v}(self, {w}: int = {N}) -> {T}:", "    return self.{v}({w}, {N})", "class {T}({T}):", "    @{T}(\"/{w}/{w}\")", "for (int i = {N}; i < {V}.size(); i++) {", "SELECT {v}, {v} FROM {v} WHERE {v} = {N} ORDER BY {v};", "INSERT INTO {v} VALUES ({N}, '{w}', '{w}-{N}');", "{w}: {N}", "  {w}-{w}: true", "{w}.{w}.{w}={N}ms", "{C}_{C}={N}", "version: {N}.{N}.{N}-{w}{N}", "image: {w}/{w}:{N}.{N}", "port: {N}", "host = {w}{N}.{w}.{w}", "{w}{N}", "{R}", "{T}{N}", "({N} {v})", "ref {w}-{w}-{N}", "\"{w}\": \"{w} {w} {N}\",", "\"{V}\": {N},", "    \"{V}\": [\"{w}\", \"{w}{N}\"],", "uuid {G}", "{w} {H} {w}", "at app.{w}.{T}.{V}({T}.java:{N})", "}", "{", ");", "", "return null;", "#!/bin/sh", "}, {w});", "assert {v}({N}) == '{w}{N}'", "\"{w}{N}.wav\"", "C:\\{w}\\{w}\\{R}\\{N}_{N}.wav", "{N}%", "#{N}", "v{N}", "{w}[{N}]", "!{w}({V})", "{V} != {V} && {V} > {N}", "${V} {N}", "&{w}; <{w}>{w}</{w}>", "a{N}b{N}",
)
_PLACEHOLDER_VALUES = (
    "********", "xxxx", "****", "<<MASKED>>", "<token>", "<password>", "<string>", "<your-token>", "your-token-here", "YOUR_API_KEY", "INSERT_TOKEN", "INSERT_PASSWORD_HERE", "TODO", "changeme", "null", "None", "[REDACTED]", "<redacted>", "<account>", "...",
    "{{password}}", "{{%VToken}}", "${%C_PASSWORD}", "${%C_TOKEN:}", "$%C_TOKEN", "%(password)s", "#{%w.password}", "${{ secrets.%C_TOKEN }}", "（請填入密碼）", "@%w.password@", "process.env.%C_TOKEN", "{password}", "", "example", "placeholder",
)


class _Writer:
    """Lines from templates with generated values; deterministic."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 2, 2, 3))))

    def alnum(self, n: int, alphabet: str = _ALNUM) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(n))

    def hex(self, n: int) -> str:
        return self.alnum(n, "0123456789abcdef")

    def b64(self, n: int) -> str:
        return self.alnum(n, _ALNUM + "+/")

    def password(self) -> str:
        r, w = self.r, self.word
        kind = r.randrange(9)
        sign = r.choice("!#$%*?^&~")
        if kind == 0:
            return f"{w().title()}{r.randrange(10, 9999)}{sign}"
        if kind == 1:
            return f"{w()}_{w().title()}{sign}{r.randrange(10, 99)}"
        if kind == 2:
            return f"{w()}-{w()}-{w()}{r.randrange(1, 99)}"
        if kind == 3:
            k = r.randrange(4, 10)
            return self.alnum(k) + sign + self.alnum(r.randrange(2, 6))
        if kind == 4:
            return self.alnum(r.randrange(10, 20)) + str(r.randrange(10))
        if kind == 5:
            return f"{w()}{r.randrange(10, 9999)}"
        if kind == 6:
            return f"{w().title()}{w().title()}{r.randrange(1, 999)}{r.choice(['', sign])}"
        return self.alnum(r.randrange(9, 18), _ALNUM if kind == 7 else _ALNUM[:49])

    def signed(self) -> str:
        """A password that shows by itself: letters of both cases or digits with signs that no name has."""
        r, w = self.r, self.word
        sign = r.choice("!#$%*?^&~!")
        return r.choice((f"{w().title()}{r.randrange(10, 9999)}{sign}", f"{w().title()}{r.randrange(1, 99)}{w()}{sign}", f"{w()}{sign}{r.randrange(10, 9999)}", f"{self.alnum(r.randrange(4, 8))}{sign}{self.alnum(2)}{r.randrange(10)}", f"{w().title()}_{w()}{r.randrange(99)}{sign}"))

    def token(self) -> str:
        r = self.r
        kind = r.randrange(8)
        if kind == 0:
            return r.choice(("sk-live-", "sk-", "key-", "tok_", "pat_", "ghp_", "xoxb-", "api_", "rk_live_", "AKIA")) + self.alnum(r.randrange(20, 40))
        if kind == 1:
            return self.hex(r.choice((32, 40, 64)))
        if kind == 2:
            return r.choice("abcdfkmwxz") + self.hex(31)
        if kind == 3:
            return self.b64(r.choice((40, 44, 43, 64)))
        if kind == 4:
            return f"eyJ{self.alnum(r.randrange(15, 40))}.eyJ{self.alnum(r.randrange(30, 90))}.{self.alnum(r.randrange(30, 60), _ALNUM + '-_')}"
        if kind == 5:
            return self.b64(r.choice((22, 30, 43))) + r.choice(("=", "=="))
        return self.alnum(r.randrange(20, 40))

    def basic(self) -> str:
        return base64.b64encode(f"{self.word()}{self.r.randrange(99)}:{self.password()}".encode()).decode()

    def block(self, kind: str) -> str:
        sep = self.r.choice(("\n", "\n", "\\n"))
        body = sep.join(self.b64(64) for _ in range(self.r.randrange(2, 6)))
        return f"-----BEGIN {kind}-----{sep}{body}{sep}-----END {kind}-----"

    def placeholder(self) -> str:
        p = self.r.choice(_PLACEHOLDER_VALUES)
        return p.replace("%C", self.word().upper()).replace("%V", self.word()).replace("%w", self.word())

    def fill(self, template: str, secret: str) -> tuple[str, list[tuple[int, int]]]:
        """The line and where its secret stands."""
        out, spans = "", []
        for part in re.split(r"(\{[A-Za-z]\})", template):
            if part == "{X}":
                secret = self.signed()
            if part in ("{S}", "{X}"):
                spans.append((len(out), len(out) + len(secret)))
                out += secret
            elif re.fullmatch(r"\{[A-Za-z]\}", part):
                out += self.value(part[1])
            else:
                out += part
        return out, spans

    def value(self, kind: str) -> str:
        r, w = self.r, self.word
        return {
            "w": lambda: w(),
            "v": lambda: f"{w()}_{w()}",
            "U": lambda: w() + r.choice(("", str(r.randrange(99)))),
            "W": lambda: w(),
            "C": lambda: w().upper(),
            "V": lambda: r.choice((w(), w() + w().title(), w() + w().title() + w().title())),
            "T": lambda: w().title() + w().title(),
            "N": lambda: str(r.randrange(1, 9999)),
            "R": lambda: self.alnum(5),
            "H": lambda: self.hex(r.choice((32, 40, 64, 40))),
            "G": lambda: "-".join(self.hex(n) for n in (8, 4, 4, 4, 12)),
            "B": lambda: self.b64(r.randrange(40, 120)) + r.choice(("", "=", "==")),
            "P": lambda: self.placeholder(),
            "K": lambda: self.block(r.choice(("PUBLIC KEY", "CERTIFICATE", "RSA PUBLIC KEY", "CERTIFICATE REQUEST"))),
        }[kind]()

    def line(self) -> tuple[str, list[tuple[int, int]]]:
        r = self.r
        pick = r.random()
        indent = r.choice(("", "", "", "  ", "        "))
        if pick < 0.27:
            t, s = r.choice(_SECRET_LINES), self.password()
        elif pick < 0.45:
            t, s = r.choice(_TOKEN_LINES), self.token()
        elif pick < 0.49:
            t, s = r.choice(_BASIC_LINES), self.basic()
        elif pick < 0.53:
            t, s = r.choice(_BLOCK_LINES), self.block(r.choice(("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY")))
        else:
            t, s = r.choice(_CLEAN_LINES), ""
        line, spans = self.fill(t, s)
        return indent + line, [(a + len(indent), b + len(indent)) for a, b in spans]

    def body(self) -> tuple[list[str], list[int]]:
        """Tokens and labels of one object of a request body, as :func:`_object_tokens` makes them."""
        r = self.r
        user_key, pass_key = r.choice((("username", "password"), ("userName", "passWord"), ("account", "pwd"), ("username", "passwd"), ("user", "password"), ("login", "pass"), ("email", "password"), ("uid", "secret")))
        real_user = r.choice((f"{self.word()}{r.randrange(1, 999)}", self.word(), f"{self.word()}.{self.word()}"))
        real_pass = r.choice((self.password(), self.password(), real_user if any(map(str.isdigit, real_user)) else self.password()))
        pairs = []
        if r.random() < 0.85:
            bad = r.random() < 0.3
            v = self.placeholder() if bad else real_user
            pairs.append((user_key, v, OTHER if bad or not v else USER))
        if r.random() < 0.9:
            bad = r.random() < 0.3
            v = self.placeholder() if bad else real_pass
            pairs.append((pass_key, v, OTHER if bad or not v else SECRET))
        if r.random() < 0.3:
            r.shuffle(pairs)
        if r.random() < 0.3 or not pairs:
            pairs.append(r.choice((("kind", f"{r.randrange(2000, 2040)}/{self.word()}/{self.word().upper()}", OTHER), ("code", self.alnum(5), OTHER), (f"{self.word()}Id", self.alnum(5), OTHER), (self.word(), self.word(), OTHER), (f"{self.word()}Name", f"{self.word()}{r.randrange(99)}", OTHER), ("comment", "", OTHER), ("id", str(r.randrange(99)), OTHER), ("score", str(r.randrange(20)), OTHER))))
        tokens, tags = [], []
        for k, v, label in pairs:
            tokens += ['"', k, '"', ":", '"']
            tags += [OTHER] * 5
            if v:
                tokens.append(v)
                tags.append(label)
            tokens += ['"', ","]
            tags += [OTHER] * 2
        return tokens, tags


def tags_for(tokens: list[tuple[int, int, str]], spans: list[tuple[int, int]]) -> list[int]:
    return [SECRET if any(a >= s and b <= e for s, e in spans) else OTHER for a, b, _ in tokens]


@lru_cache(maxsize=1)
def model(lines: int = TRAINING_LINES, seed: int = 11) -> crf.Crf:
    """The trained CRF; fitted once per process on ``lines`` generated lines."""
    w = _Writer(seed)
    seqs, tags = [], []
    for i in range(lines):
        body = i % 6 == 5
        if body:
            toks, lab = w.body()
        else:
            line, spans = w.line()
            lexed = lex(line)
            toks, lab = [t for _, _, t in lexed], tags_for(lexed, spans)
        if toks:
            seqs.append(features(toks, body))
            tags.append(lab)
    return crf.train(seqs, tags, LABELS, epochs=12)


# ---------------------------------------------------------------- application

_BEGIN = "-----BEGIN "
_BLOCK_RE = re.compile(_PEM, re.S)


def _units(text: str) -> Iterator[tuple[int, str]]:
    """(offset, line) of a text; a key block with all its lines is part of the line it begins on."""
    blocks = [m.span() for m in _BLOCK_RE.finditer(text)] if _BEGIN in text else []
    start, n = 0, len(text)
    bi = 0
    while start <= n:
        end = text.find("\n", start)
        end = n if end < 0 else end
        while bi < len(blocks) and blocks[bi][0] < end:
            if blocks[bi][1] > end:
                end = text.find("\n", blocks[bi][1])
                end = n if end < 0 else end
            bi += 1
        yield start, text[start:end]
        start = end + 1


class Finder:
    """Labels lines by their sequences of token classes; each sequence is decoded once while the cache holds it."""

    def __init__(self, fitted: crf.Crf) -> None:
        self.crf = fitted
        self.classes: dict[TokenClass, int] = {}
        self.by_number: list[TokenClass] = []
        self.numbers: dict[str, int] = {}
        self.labels: dict[tuple, bytes] = {}
        self.cache: dict[str, tuple[tuple[int, int], ...]] = {}

    def number(self, token: str) -> int:
        """The number of the token's class."""
        n = self.numbers.get(token)
        if n is None:
            if len(self.numbers) > CACHE_TOKENS:
                self.numbers.clear()
            c = token_class(token, self.crf.index.__contains__)
            n = self.classes.setdefault(c, len(self.by_number))
            if n == len(self.by_number):
                self.by_number.append(c)
            if len(token) < 100:
                self.numbers[token] = n
        return n

    def label(self, sequences: list[tuple[int, ...]], body: bool = False) -> list[bytes]:
        """The label of each token of each sequence of class numbers."""
        known = self.labels
        if len(known) > CACHE_SEQUENCES:
            known.clear()
        new = list(dict.fromkeys(x for x in sequences if (body, x) not in known))
        new.sort(key=len)  # sequences of like length are decoded together
        for i in range(0, len(new), BATCH_LINES):
            part = new[i : i + BATCH_LINES]
            decoded = self.crf.decode([class_features([self.by_number[n] for n in x], body) for x in part])
            for x, y in zip(part, decoded):
                known[body, x] = y.astype(np.uint8).tobytes()
        return [known[body, x] for x in sequences]

    def lines(self, lines: list[str]) -> dict[str, tuple[tuple[int, int], ...]]:
        """The secret spans of each of the given lines."""
        cache = self.cache
        if len(cache) > CACHE_LINES:
            cache.clear()
        new = list(dict.fromkeys(x for x in lines if x not in cache))
        number = self.number
        lexed = [lex(x) for x in new]
        for line, toks, labels in zip(new, lexed, self.label([tuple([number(t) for _, _, t in x]) for x in lexed])):
            if SECRET not in labels:
                cache[line] = ()
                continue
            spans: list[list[int]] = []
            before = OTHER
            for (a, b, _), y in zip(toks, labels):
                if y == SECRET:
                    if before == SECRET and a == spans[-1][1]:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
                before = y
            cache[line] = tuple((a, b) for a, b in spans)
        return cache

    def texts(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """Spans of the secrets of each text, in code points."""
        todo = [[(a, x) for a, x in _units(t) if x] if t else [] for t in texts]
        found = self.lines([x for units in todo for _, x in units])
        return [[(o + a, o + b) for o, x in units for a, b in found[x]] for units in todo]


#: One finder per worker process and model: what it has seen stays known from task to task.
_FINDERS: dict[str, Finder] = {}


def _finder(fitted: crf.Crf, mark: str) -> Finder:
    if mark not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[mark] = Finder(fitted)
    return _FINDERS[mark]


def _mark(fitted: crf.Crf) -> str:
    return hashlib.blake2b(fitted.emit.tobytes() + fitted.trans.tobytes() + "\0".join(fitted.index).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


# ---------------------------------------------------------------- request bodies

_ESCAPED = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|.", re.S)


class _Value(NamedTuple):
    """A scalar of a body: its decoded text and where each of its characters stands in the body (``None``: as it is)."""

    text: str
    start: int
    end: int
    places: tuple[int, ...] | None
    quoted: bool

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.places is None:
            return self.start + a, self.start + b
        return self.places[a], self.places[b]


def _string(body: str, text: str, start: int, end: int, outer: Callable[[int], int]) -> _Value:
    """The string between the quotes at ``start`` and ``end``; ``outer`` gives a place's offset in the whole body."""
    a, b = start + 1, end - 1
    first, last = outer(a), outer(b)
    if last - first == len(text):
        return _Value(text, first, last, None, True)
    places = [outer(m.start()) for m in _ESCAPED.finditer(body, a, b)]
    return _Value(text, first, last, (*places, last), True)


def _objects(body: str, outer: Callable[[int], int] = lambda i: i) -> tuple[list[list[tuple[str, _Value]]], list[_Value]]:
    """(the objects of a JSON text with their own scalars by key, the strings outside of objects); ValueError if it is no JSON.

    Items of a list count under the key of the list.  A string that is a whole JSON value is
    read as what it holds.
    """
    objects: list[list[tuple[str, _Value]]] = []
    loose: list[_Value] = []
    stack: list[tuple[list | None, str]] = []
    own: list | None = None
    key = ""
    for kind, value, start, end in jsontext.tokens(body):
        if kind == "key":
            key = value
        elif kind in ("{", "["):
            stack.append((own, key))
            if kind == "{":
                own = []
                objects.append(own)
        elif kind in ("}", "]"):
            own, key = stack.pop()
        elif kind in ("string", "number"):
            v = _string(body, value, start, end, outer) if kind == "string" else _Value(value, outer(start), outer(end), None, False)
            s = value.strip()
            if kind == "string" and len(s) > 1 and s[0] + s[-1] in ("{}", "[]", '""'):
                try:
                    more, rest = _objects(value, lambda i, v=v: v.span(i, i)[0])
                    objects += more
                    loose += rest
                    continue
                except ValueError:
                    pass
            if own is None:
                loose.append(v)
            else:
                own.append((key, v))
    return objects, loose


_QUOTE_TOKENS = ('"', ":", ",")


def body_spans(finder: Finder, bodies: list[str | None]) -> list[list[tuple[int, int, str, bool]]]:
    """(start, end, value, quoted) of the secrets and user names of JSON bodies; other bodies are read as text.

    A user name counts where a password of the same object does.  Values of several words are
    read as texts, key blocks aside; so are URLs and strings outside of objects.  ``quoted``: the
    span stands within quotes, so that a plain word may take its place.
    """
    quote, colon, comma = (finder.number(t) for t in _QUOTE_TOKENS)
    out: list[list[tuple[int, int, str, bool]]] = [[] for _ in bodies]
    seqs: list[tuple[int, ...]] = []
    where: list[tuple[int, list[tuple[int, _Value]]]] = []
    as_text: list[tuple[int, _Value]] = []
    for i, b in enumerate(bodies):
        if not b:
            continue
        try:
            objects, loose = _objects(b)
        except ValueError:
            objects, loose = [], [_Value(b, 0, len(b), None, True)]
        as_text += [(i, v) for v in loose]
        for obj in objects:
            seq: list[int] = []
            at: list[tuple[int, _Value]] = []
            for k, v in obj:
                seq += (quote, finder.number(k or "_"), quote, colon, quote)
                if v.text:
                    if "://" in v.text or (re.search(r"\s", v.text) and not v.text.startswith(_BEGIN)):
                        as_text.append((i, v))
                    else:
                        at.append((len(seq), v))
                    seq.append(finder.number(v.text))
                seq += (quote, comma)
            if at:
                seqs.append(tuple(seq))
                where.append((i, at))
    for (i, at), labels in zip(where, finder.label(seqs, True)):
        if SECRET in labels and any(labels[n] == SECRET for n, _ in at):
            out[i] += [(v.start, v.end, v.text, v.quoted) for n, v in at if labels[n] != OTHER]
    for (i, v), spans in zip(as_text, finder.texts([v.text for _, v in as_text])):
        out[i] += [(*v.span(a, b), v.text[a:b], v.quoted) for a, b in spans]
    return [sorted(x) for x in out]


def body_secrets(finder: Finder, bodies: list[str | None]) -> list[list[str]]:
    """The decoded values of :func:`body_spans`, in the order of the body."""
    return [[v for _, _, v, _ in spans] for spans in body_spans(finder, bodies)]


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span replaced; everything else stays as it is."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], REDACTED]
        at = b
    return "".join(out) + text[at:]


def redact_body(body: str, spans: list[tuple[int, int, str, bool]]) -> str:
    """A body with exactly the spans of :func:`body_spans` replaced, so layout, escapes and equal values elsewhere stay.

    A number is replaced by a quoted word, so that JSON stays JSON.
    """
    out, at = [], 0
    for a, b, _, quoted in spans:
        if a < at:
            continue
        out += [body[at:a], REDACTED if quoted else f'"{REDACTED}"']
        at = b
    return "".join(out) + body[at:]


def _chunks(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    part, chars, first = [], 0, 0
    for i, t in enumerate(texts):
        part.append(t)
        chars += len(t or "")
        if chars >= size:
            yield first, part
            part, chars, first = [], 0, i + 1
    if part:
        yield first, part


def find_in_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, secret): each distinct secret of each row once, as the text holds it.

    Null and empty texts hold none.  Row-local: one pass, no shuffle.
    """
    return _run(df, key, text, False)


def find_in_bodies(df: DataFrame, key: str, body: str) -> DataFrame:
    """(row_id, secret) of JSON request bodies: passwords and their user names, decoded."""
    return _run(df, key, body, True)


def _run(df: DataFrame, key: str, text: str, bodies: bool) -> DataFrame:
    fitted = model()
    mark = _mark(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(fitted, mark)
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            ids, found = [], []
            for first, part in _chunks(b.column(1).to_pylist()):
                got = body_secrets(finder, part) if bodies else [[t[a:z] for a, z in s] if s else [] for t, s in zip(part, finder.texts(part))]
                for i, values in enumerate(got):
                    for v in dict.fromkeys(values):
                        ids.append(keys[first + i])
                        found.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)), pa.array(found, pa.string())], ["row_id", "secret"])

    narrow = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    return spread(narrow).mapInArrow(run, "row_id bigint, secret string")


def redact_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, text, secrets) of the rows that hold secrets: the text with each replaced, and their number."""
    return _redact(df, key, text, False)


def redact_bodies(df: DataFrame, key: str, body: str) -> DataFrame:
    """The same for JSON request bodies; ``secrets`` counts distinct values, user names included."""
    return _redact(df, key, body, True)


def _redact(df: DataFrame, key: str, text: str, bodies: bool) -> DataFrame:
    fitted = model()
    mark = _mark(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(fitted, mark)
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            ids, texts, counts = [], [], []
            for first, part in _chunks(b.column(1).to_pylist()):
                found_here = body_spans(finder, part) if bodies else finder.texts(part)
                for i, (t, hits) in enumerate(zip(part, found_here)):
                    if hits:
                        ids.append(keys[first + i])
                        texts.append(redact_body(t, hits) if bodies else redact(t, hits))
                        counts.append(len({h[2] for h in hits}) if bodies else len(hits))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, np.int64)), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["row_id", "text", "secrets"]
            )

    narrow = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    return spread(narrow).mapInArrow(run, "row_id bigint, text string, secrets int")


def redacted(traces: DataFrame, grading: DataFrame) -> DataFrame:
    """(src, row_id, text, secrets) of the prompts and bodies that hold secrets."""
    a = redact_text(traces, "id", "prompt").select(F.lit("llm_traces").alias("src"), "row_id", "text", "secrets")
    b = redact_bodies(grading, "entry_id", "raw_body").select(F.lit("grading_controller").alias("src"), "row_id", "text", "secrets")
    return a.unionByName(b)


def found(traces: DataFrame, grading: DataFrame) -> DataFrame:
    """(src, row_id, secret) over ``llm_traces.prompt`` and ``grading_controller.raw_body``."""
    a = find_in_text(traces, "id", "prompt").select(F.lit("llm_traces").alias("src"), "row_id", "secret")
    b = find_in_bodies(grading, "entry_id", "raw_body").select(F.lit("grading_controller").alias("src"), "row_id", "secret")
    return a.unionByName(b)
