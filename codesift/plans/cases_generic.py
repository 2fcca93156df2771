"""Source texts that exercise the generic pack.

Each case is a list of files (path, body, note style).  ``@@ID@@`` becomes the
document number.  The note style says how the document's own text is appended,
so that every query also runs over the whole texts.  Credential shapes are
joined from halves and are not real.
"""

_PEM = "-----BEGIN " + "RSA PRIVATE KEY-----"
_AWS = "AK" + "IA" + "Q7RZTX4M2N8PLB5C"
_GIT = "gh" + "p_" + "a1b2c3d4e5f6g7h8i9j0k1l2m3n4o5p6q7r8"
_CHAT = "xo" + "xb-" + "210987654321-kjihgfedcba"
_PAY = "sk_" + "live_" + "9x8y7z6w5v4u3t2s1r"
_SHA = "89abcdef0123456789abcdef0123456789abcdef"

GENERIC_CASES = [
    ("env_file", [("app@@ID@@/.env", "API_KEY=QwErTyUiOp@@ID@@AsDfGhJkLz\nDEBUG=1\n", "#")]),
    ("env_template", [("app@@ID@@/.env.sample", "# copy to .env, then fill in\nSTORAGE_TOKEN=put-the-real-one-in-here\nLOG_LEVEL=info\n", "#")]),
    ("token_shapes", [("keys@@ID@@/notes.txt", f"{_PEM}\nid {_AWS} x\n{_GIT}\n  {_CHAT}\nkey={_PAY}\nz{_AWS}\n", "raw")]),
    ("token_in_tests", [("keys@@ID@@/testdata/token.txt", f"{_GIT}\n{_AWS}\n", "raw")]),
    ("config_json", [("conf@@ID@@/config.json", '{\n  "SESSION_SECRET": "Zx9Cv8Bn7Mq6@@ID@@Wt5Er4",\n  "retries": 3\n}\n', "//")]),
    ("prose_in_json", [("conf@@ID@@/rules.json", '{"rules": [{"when": "a line like password: hunter, or worse", "then": "ask where the secret: came from"}]}\n', "//")]),
    ("ini_in_tests", [("conf@@ID@@/fixtures/settings.ini", "token=Zx9Cv8Bn7Mq6Wt5Er4Ty3\n", "#")]),
    ("yaml_settings", [("conf@@ID@@/settings.yaml", "db:\n  password: Pq3Rs7Tv@@ID@@Wx1Yz5Ab  # rotate\n  token: short\n  auth_token: dev-Pq3Rs7TvWx1Yz5Ab\n  client-secret: aaaaaaaaaaaaaaaaaaaa\n", "#")]),
    ("workflow_open", [(".github/workflows/nightly@@ID@@.yml", "name: nightly\npermissions: write-all\non:\n  issue_comment:\njobs:\n  build:\n    steps:\n    - name: sources\n      uses: acme/fetch-sources@v2.1\n    - uses: 'acme/lint@release'\n    - run: |\n        echo \"${{ github.event.comment.body }}\" >> notes\n", "#")]),
    ("workflow_pinned", [(".github/workflows/pin@@ID@@.yaml", f"jobs:\n  t:\n    steps:\n      - uses: actions/checkout@{_SHA}\n      - run: echo ${{{{ github.sha }}}}\n", "#")]),
    ("workflow_mixed", [(".github/workflows/pr@@ID@@.yml", f"on:\n  Pull_Request_Target:\njobs:\n  t:\n    steps:\n      - uses: actions/checkout@{_SHA}\n        with:\n          ref: ${{{{ github.event.pull_request.head.sha }}}}\n", "#")]),
    ("image_open", [("svc@@ID@@/Dockerfile", "ARG BASE=debian:12\nFROM $BASE\nRUN curl -s https://get.invalid/setup | sh -s -- --yes\nARG REGISTRY_PASSWORD=Vb5Nm9Lk@@ID@@Qw3Er7Ty\nENV CACHE_TOKEN changeme\n", "#")]),
    ("image_user", [("svc@@ID@@/Dockerfile", "FROM golang:1.24 AS build\nRUN make\nFROM alpine:3.22\n  user 1000\n", "#")]),
    ("image_stages", [("svc@@ID@@/Dockerfile.prod", "FROM node:22 AS build\nUSER node\nFROM alpine:3.22\nCOPY --from=build /a /a\n", "#")]),
    ("image_entry", [
        ("hub@@ID@@/Dockerfile", "FROM debian:12\nCOPY . /hub\nENTRYPOINT [\"/hub/bin/boot@@ID@@.bash\"]\n", "#"),
        ("hub@@ID@@/bin/boot@@ID@@.bash", "#!/usr/bin/env bash\nchown -R hub /data\nexec su-exec hub \"$@\"\n", "#"),
    ]),
    ("image_entry_root", [
        ("box@@ID@@/Dockerfile", "FROM alpine:3.22\nENTRYPOINT [\"/go/start@@ID@@.sh\"]\n", "#"),
        ("box@@ID@@/start@@ID@@.sh", "#!/bin/sh\ncurl -fsSL https://host.invalid/x |  sh\nexec \"$@\"\n", "#"),
    ]),
    ("todo_notes", [
        ("web@@ID@@/app.js", "const text = 'TODO check permission @@ID@@';\n// FIXME: check permission @@ID@@ first\n", "//"),
        ("web@@ID@@/README.md", "TODO: check permission\n", "raw"),
        ("web@@ID@@/tool.py", "# rotate the credential, hack @@ID@@\nx = 1  # TODO secret\n", "#"),
    ]),
    ("dependency", [("node_modules/lib@@ID@@/index.js", "const options = { rejectUnauthorized: false };\neval(x);\n", "//")]),
    ("other_kinds", [
        ("etc@@ID@@/main.rs", "fn main() {}\n", "//"),
        ("etc@@ID@@/style.scss", "a { b: c }\n", "//"),
        ("etc@@ID@@/data.bin", "AB\x01C\n", "raw"),
        ("etc@@ID@@/Main.KT", "fun main() {}\n", "//"),
        ("etc@@ID@@/e2e/page.spec.tsx", "const x = 1;\n", "//"),
    ]),
]
