"""What the code tables must hold for the literal cases, read off their sources.

Rows are (path of the case, values); names and lines are those of the sources in
``cases_js`` and ``cases_go``.
"""

# Bindings of scripts that a lower-trust source reaches: line and name.  What stands before a
# property that is set counts as set, and so do the words of an annotation.
TAINTED = {
    "desk@@ID@@/guestbook.jsx": [(3, "draft"), (4, "pane"), (7, "Entry"), (7, "dangerouslySetInnerHTML"), (7, "li")],
    "desk@@ID@@/tickets.ts": [(8, "rows")],
    "gate@@ID@@/redirects.js": [(6, "feature")],
    "mail@@ID@@/breaks.mjs": [(2, "next"), (10, "location")],
    "mail@@ID@@/courier.ts": [(4, "address"), (4, "string"), (5, "hop"), (8, "page"), (11, "sql"), (13, "node")],
    "mail@@ID@@/stopped.ts": [(2, "let"), (2, "parcel"), (8, "hidden"), (8, "inner"), (15, "link")],
}

# Imports of scripts: local name, family of the module, member (* for all of it).
IMPORTED = {
    "desk@@ID@@/shelf.ts": [("fs", "fs", "*"), ("path", "path", "*")],
    "desk@@ID@@/tickets.ts": [("disk", "fs", "*"), ("join", "path", "join")],
    "gate@@ID@@/redirects.js": [("spawnSync", "program", "spawnSync")],
    "mail@@ID@@/courier.ts": [("get", "http", "get")],
    "mail@@ID@@/router.cjs": [("child", "program", "*"), ("child", "shell", "*")],
    "press@@ID@@/queue.js": [("exec", "shell", "exec"), ("shell", "shell", "execSync")],
    "sheet@@ID@@/cell.mjs": [("runner", "vm", "*")],
}

# Bindings of Go files: line, name, whether their value is unknown, whether a source reaches them.
# ``notes`` is the constant that holds the document.
GO_BOUND = {
    "audit@@ID@@/log.go": [(18, "notes", False, False)],
    "backup@@ID@@/run.go": [(12, "dump", False, False), (13, "err", False, False), (16, "pack", False, False), (24, "notes", False, False)],
    "ferry@@ID@@/client.go": [(15, "settings", False, False), (26, "quick", False, False), (27, "slow", False, False), (31, "notes", False, False)],
    "kiosk@@ID@@/handlers.go": [(19, "resp", True, False), (22, "digest", False, True), (34, "notes", False, False)],
    "ledger@@ID@@/store.go": [(23, "notes", False, False)],
    "lottery@@ID@@/draw.go": [
        (15, "sessionKey", False, False), (16, "winner", False, False), (18, "sum", False, False), (19, "etag", False, False),
        (21, "page", True, False), (22, "part", True, False), (25, "notes", False, False),
    ],
    "relay@@ID@@/alias.go": [(12, "notes", False, False)],
    "relay@@ID@@/fake.go": [(7, "help", False, False), (14, "notes", False, False)],
    "relay@@ID@@/relay.go": [
        (6, "where", False, True), (7, "next", False, True), (9, "next", False, False), (12, "tool", False, True), (14, "who", False, True),
        (15, "sentence", False, True), (17, "file", False, True), (22, "where", False, True), (23, "where", False, False),
        (25, "where", False, False), (28, "where", False, True), (33, "notes", False, False),
    ],
    "tool@@ID@@/main.go": [(14, "notes", False, False)],
    "uploads@@ID@@/files.go": [
        (9, "shape", False, False), (10, "anything", False, False), (34, "wanted", False, False), (40, "size", True, False), (43, "found", True, False),
        (44, "one", True, False), (47, "cover", False, False), (48, "above", False, False), (52, "notes", False, False),
    ],
}
