"""Column layouts shared by rule packs, and the rule catalogue."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1"
TOOL_VERSION = "0.1.0"

GENERIC = "generic"
GO = "go"
JS = "javascript-typescript"

NV = "needs_validation"
HARD = "hardening"

SECRETS = "Cryptography and secrets"
OBVIOUS = "Obvious things"
SUPPLY = "Supply chain and release"
CLOUD = "Cloud and deployment"
INJECTION = "Injection"
FILES = "Resource and file handling"
EXHAUSTION = "Resource exhaustion and availability"
CLIENT = "Client-side and rendering"

FILE_SCHEMA = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)

# What a rule pack returns.  ``variant`` picks a row of the rule catalogue.
# (phase, pos, rule_no) is the emission order inside one file.
RAW_COLUMNS = [
    "repo", "path", "rule_id", "variant", "verdict", "confidence", "line", "column", "evidence",
    "phase", "pos", "rule_no",
]

# What to change, and what to find out before a finding counts; several rules share a subject.
_ADVICE = {
    "env": (
        "Delete the file from this tree and its history, issue new values, and commit a sample with blanks instead.",
        "Does anyone outside the team receive this tree, and does a listed value still work?",
    ),
    "token": (
        "Revoke the value where it was issued; read its successor from the environment at start-up.",
        "Ask the issuer whether this value is live, and find out who can read the tree.",
    ),
    "setting": (
        "Replace the literal by a reference that deployment fills in; write samples so that nobody takes them for real.",
        "Try to find the system this value opens; a fixture or sample closes the finding.",
    ),
    "todo": (
        "Turn the note into a ticket with an owner, or write the missing check and delete the note.",
        "",
    ),
    "pin": (
        "Write the 40-digit commit after the @ sign and let a bot propose newer ones.",
        "",
    ),
    "perms": (
        "List the few scopes that the steps use; everything unlisted is then denied.",
        "",
    ),
    "event": (
        "Assign the field to an env entry and read it as a quoted shell variable.",
        "Look at the step that holds the expression: does a shell parse it, and what may its token do?",
    ),
    "prtarget": (
        "Build the proposed code in a workflow without secrets; hand only its artifacts to the privileged one.",
        "Which commit does the checkout take, and do later steps execute files from it?",
    ),
    "layer": (
        "Mount the secret for the one RUN line that needs it, or set it when the container starts.",
        "Inspect the image history: is the value there, and does it open anything?",
    ),
    "pipe": (
        "Download to a file, compare its checksum with a recorded one, and only then execute it.",
        "",
    ),
    "root": (
        "Add a USER line after the last COPY, or drop privileges at the start of the entrypoint.",
        "",
    ),
    "tls": (
        "Give the connection the certificate it should trust; leave checking switched on.",
        "Which peer does this connection talk to, and who sits on the network between?",
    ),
    "shell": (
        "Start the program itself with a list of arguments, so that no shell reads the text.",
        "Follow each part of the text to where it enters the program.",
    ),
    "sql": (
        "Put values into placeholders, and pick column or table names from a list in the code.",
        "Follow each joined part to its origin, and check that the receiver is a database handle.",
    ),
    "path": (
        "Compare the cleaned result with the root folder, or look the name up in a fixed set.",
        "Can the name hold a separator or two dots by the time it arrives here?",
    ),
    "random": (
        "Draw the bytes from the system's secure source.",
        "What could somebody do who predicts the next value?",
    ),
    "readall": (
        "Wrap the reader so that it stops after the largest size you expect.",
        "Who sends this body, and does a proxy or handler before this line bound it?",
    ),
    "timeout": (
        "Bound how long one exchange may last, headers included.",
        "",
    ),
    "html": (
        "Insert the value as text; where markup is wanted, run it through one audited filter.",
        "Which user wrote the value, and in whose browser is it shown?",
    ),
    "html_hint": (
        "Insert the value as text; where markup is wanted, run it through one audited filter.",
        "",
    ),
    "log": (
        "Drop the argument, or print a short digest that tells two values apart.",
        "Print the value in a test run: is it the secret or only something about it?",
    ),
    "mode": (
        "Grant access to the owner, and to a group only where one exists for this purpose.",
        "",
    ),
    "exit": (
        "Hand the error up, and end the process in main alone.",
        "Can a request or message drive execution to this line while others are being served?",
    ),
    "pprof": (
        "Register the handlers on a mux of their own that listens on the loopback address.",
        "Does the default mux listen on an address that clients reach?",
    ),
    "fetch": (
        "Resolve the host first and refuse private ranges; permit a short list of hosts, on every hop.",
        "Which addresses are left after the checks before this call?",
    ),
    "redirect": (
        "Redirect to route names of your own, and treat absolute addresses as an error.",
        "Send a foreign absolute address: does the response carry it?",
    ),
    "cookie": (
        "Switch on Secure and HttpOnly, and narrow the path.",
        "",
    ),
    "program": (
        "Let the input select an entry of a table whose values are programs.",
        "List the programs that the input can name, and the account they run under.",
    ),
    "digest": (
        "Use a slow salted function for passwords, an HMAC with SHA-256 for the rest.",
        "Is the digest compared or stored to protect something, or only a cache key?",
    ),
    "origin": (
        "Look the origin up in a set of your own sites; send no header if it isn't there.",
        "Request the page with a foreign origin and a session: are both headers in one answer?",
    ),
    "eval": (
        "Replace the evaluation by a parser, or by a table from names to functions.",
        "Follow the text back: does a request, message or file write any part of it?",
    ),
    "eval_const": (
        "Write the code where it is evaluated now.",
        "",
    ),
    "location": (
        "Accept paths of this site alone, and compare the scheme before setting a location.",
        "Open the page with a javascript: address in that field: what happens?",
    ),
    "post": (
        "Pass the origin of the frame you talk to, and leave the secret out of the message.",
        "",
    ),
    "storage": (
        "Keep the session in a cookie that scripts can't read.",
        "",
    ),
    "module": (
        "Keep a map from accepted names to import functions.",
        "Which files can the loader reach from this folder?",
    ),
    "vm": (
        "Treat the text as data; a VM context does not confine it.",
        "Follow the text back, and list the objects that the context exposes.",
    ),
}

# rule, variant, analyzer, class, verdict, confidence, title, subject of the advice
_CATALOGUE = [
    ("G001", "", GENERIC, SECRETS, NV, "high", "A file of environment settings is in the tree", "env"),
    ("G002", "", GENERIC, SECRETS, NV, "high", "Text has the header of a private key", "token"),
    ("G003", "", GENERIC, SECRETS, NV, "high", "Text has the shape of an AWS key id", "token"),
    ("G004", "", GENERIC, SECRETS, NV, "high", "Text has the shape of a GitHub token", "token"),
    ("G005", "", GENERIC, SECRETS, NV, "high", "Text has the shape of a Slack token", "token"),
    ("G006", "", GENERIC, SECRETS, NV, "high", "Text has the shape of a live Stripe key", "token"),
    ("G007", "", GENERIC, SECRETS, NV, "medium", "A credential-like setting holds a literal", "setting"),
    ("G008", "", GENERIC, OBVIOUS, HARD, "medium", "A note asks for work on a security control", "todo"),
    ("G009", "", GENERIC, SUPPLY, HARD, "high", "A workflow step can change under its name", "pin"),
    ("G010", "", GENERIC, SUPPLY, HARD, "high", "A workflow may write to everything", "perms"),
    ("G011", "", GENERIC, SUPPLY, NV, "medium", "Text from an event is pasted into a workflow", "event"),
    ("G012", "", GENERIC, SUPPLY, NV, "high", "A privileged trigger checks out proposed code", "prtarget"),
    ("G013", "", GENERIC, CLOUD, NV, "medium", "A secret is an image build argument", "layer"),
    ("G014", "", GENERIC, SUPPLY, HARD, "high", "An image build runs what it downloads", "pipe"),
    ("G015", "", GENERIC, CLOUD, HARD, "high", "The last image stage runs as root", "root"),
    ("G016", "", GENERIC, SUPPLY, HARD, "high", "A script runs what it downloads", "pipe"),
    ("GO001", "", GO, SECRETS, NV, "high", "Certificates are not checked", "tls"),
    ("GO002", "", GO, INJECTION, NV, "high", "A shell reads computed text", "shell"),
    ("GO003", "", GO, INJECTION, NV, "medium", "A query is put together from parts", "sql"),
    ("GO004", "", GO, FILES, NV, "medium", "A file path has an unchecked part", "path"),
    ("GO005", "", GO, SECRETS, NV, "high", "A secret comes from math/rand", "random"),
    ("GO006", "", GO, EXHAUSTION, NV, "high", "A body is read to its end, however long", "readall"),
    ("GO007", "", GO, EXHAUSTION, HARD, "medium", "The default client waits without limit", "timeout"),
    ("GO008", "", GO, EXHAUSTION, HARD, "medium", "A client is made without a time limit", "timeout"),
    ("GO009", "", GO, CLIENT, NV, "high", "A computed value is declared safe markup", "html"),
    ("GO010", "", GO, SECRETS, NV, "medium", "A secret-sounding name is printed", "log"),
    ("GO011", "", GO, FILES, HARD, "high", "A file mode lets everyone write", "mode"),
    ("GO012", "", GO, EXHAUSTION, NV, "medium", "A library ends the process", "exit"),
    ("GO013", "", GO, OBVIOUS, NV, "medium", "Profiling handlers come with an import", "pprof"),
    ("GO014", "", GO, EXHAUSTION, HARD, "medium", "A server is made without time limits", "timeout"),
    ("GO015", "", GO, OBVIOUS, HARD, "high", "A note asks for work on a security control", "todo"),
    ("GO016", "", GO, FILES, NV, "high", "The caller picks the address of a request", "fetch"),
    ("GO017", "", GO, INJECTION, NV, "high", "The caller picks the target of a redirect", "redirect"),
    ("GO018", "", GO, SECRETS, HARD, "high", "A session cookie lacks a protection", "cookie"),
    ("GO019", "", GO, INJECTION, NV, "high", "The caller picks the program to run", "program"),
    ("GO021", "", GO, SECRETS, NV, "medium", "An old digest covers a secret", "digest"),
    ("GO022", "", GO, CLIENT, NV, "high", "Any origin may read with credentials", "origin"),
    ("JS001", "option", JS, SECRETS, NV, "high", "Certificates are not checked", "tls"),
    ("JS001", "global", JS, SECRETS, NV, "high", "Certificates are not checked", "tls"),
    ("JS002", "", JS, INJECTION, NV, "high", "A shell reads computed text", "shell"),
    ("JS003", "dynamic", JS, INJECTION, NV, "high", "Text is evaluated as code", "eval"),
    ("JS003", "static", JS, INJECTION, HARD, "medium", "Text is evaluated as code", "eval_const"),
    ("JS004", "source", JS, CLIENT, NV, "high", "A value becomes markup", "html"),
    ("JS004", "dynamic", JS, CLIENT, HARD, "medium", "A value becomes markup", "html_hint"),
    ("JS005", "", JS, SECRETS, NV, "high", "A secret comes from Math.random", "random"),
    ("JS006", "", JS, INJECTION, NV, "medium", "A query is put together from parts", "sql"),
    ("JS007", "", JS, FILES, NV, "medium", "A file path has an unchecked part", "path"),
    ("JS008", "", JS, FILES, NV, "high", "The caller picks the address of a request", "fetch"),
    ("JS009", "", JS, CLIENT, NV, "high", "The caller picks where the browser goes", "location"),
    ("JS010", "", JS, CLIENT, HARD, "high", "A secret is posted to any origin", "post"),
    ("JS011", "", JS, SECRETS, HARD, "high", "A secret is kept in web storage", "storage"),
    ("JS012", "", JS, INJECTION, NV, "high", "The caller picks the target of a redirect", "redirect"),
    ("JS013", "", JS, SECRETS, NV, "medium", "A secret-sounding name is printed", "log"),
    ("JS014", "", JS, INJECTION, NV, "high", "The caller picks the module to load", "module"),
    ("JS015", "", JS, INJECTION, NV, "high", "Text is compiled in a VM context", "vm"),
    ("JS016", "", JS, INJECTION, NV, "high", "The caller picks the program to run", "program"),
    ("JS017", "", JS, CLIENT, NV, "high", "Any origin may read with credentials", "origin"),
]

# rule, variant, analyzer, class, verdict, confidence, title, remediation, blocker
_ROWS = [(*row[:7], *_ADVICE[row[7]]) for row in _CATALOGUE]

RULE_IDS = sorted({row[0] for row in _ROWS})
RULE_COLUMNS = [
    "rule_id", "variant", "analyzer", "attack_class", "verdict", "confidence", "title", "remediation", "blocker",
]


def local_table(spark: SparkSession, rows: list[tuple], names: list[str], types: list[pa.DataType] | None = None) -> DataFrame:
    """A small literal table that stays on the JVM side (no Python workers)."""
    kinds = types or [pa.string()] * len(names)
    columns = [pa.array([row[i] for row in rows], type=kinds[i]) for i in range(len(names))]
    return spark.createDataFrame(pa.table(columns, names=names))


def rule_catalogue(spark: SparkSession, own_rules: list[tuple] = []) -> DataFrame:
    """One row per rule and variant: 58 fixed rows and those registered with own packs, which
    are written in code, so it may be broadcast."""
    return local_table(spark, [*_ROWS, *own_rules], RULE_COLUMNS).withColumn(
        "description", F.concat_ws(". ", F.col("title"), F.lit("A static signal; it does not prove impact by itself"))
    )
