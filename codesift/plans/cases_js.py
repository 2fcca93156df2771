"""Script sources with the findings they must produce.

(name, files, expected) where expected rows are (rule, variant, line, text at the
finding's column, evidence); the column is looked up in the source line.  Each program
is a small piece of an invented product, written from what the rules look for.
"""

# A helper that the rules must recognise: it replaces what opens markup by entities.
_QUOTE_HELPER = """function plain(given) {
  const names = { "<": "&lt;", ">": "&gt;", "&": "&amp;" };
  return `${given}`.replace(/[<>&]/gu, (one) => names[one]);
}
"""

JS_CASES = [
    ("js_printer", "press@@ID@@/queue.js", """'use strict';
const { execSync: shell, exec } = require('child_process');

class Queue {
  constructor(host) {
    this.socket = connect(host, { servername: host, rejectUnauthorized: false, timeout: 4000 });
  }

  submit(job) {
    shell('lp -d ' + job.printer + ' ' + job.path, { cwd: '/var/spool' });
    exec(job.after, () => this.refresh(job));
    exec('lpstat -a');
  }
}

if (legacy) process.env.NODE_TLS_REJECT_UNAUTHORIZED = '0';
module.exports = Queue;
""", [
        ("JS001", "option", 6, "rejectUnauthorized", "rejectUnauthorized: false"),
        ("JS002", "", 10, "shell", "execSync(dynamic command)"),
        ("JS002", "", 11, "exec", "exec(dynamic command)"),
        ("JS001", "global", 16, "NODE_TLS", "NODE_TLS_REJECT_UNAUTHORIZED = 0"),
    ]),
    ("js_formula", "sheet@@ID@@/cell.mjs", """import * as runner from 'node:vm';

export const columns = ['a', 'b', 'c@@ID@@'];

export function compile(formula, scope) {
  const body = `return (${formula})`;
  const step = new Function(body);
  if (scope.trace) eval(scope.trace);
  runner.runInThisContext(formula, { filename: 'cell' });
  return step;
}

export const two = () => eval('1 + 1');
export const three = () => runner.runInNewContext('1 + 2', {});
""", [
        ("JS003", "dynamic", 7, "new", "new Function(dynamic code)"),
        ("JS003", "dynamic", 8, "eval", "eval(dynamic code)"),
        ("JS015", "", 9, "runner", "runInThisContext(dynamic code)"),
        ("JS003", "static", 13, "eval", "eval(static code)"),
    ]),
    ("js_gallery", "photos@@ID@@/grid.js", """const grid = document.querySelector('#grid');

export function caption(tile, photo) {
  tile.outerHTML = '<figcaption>' + photo.title + '</figcaption>';
  tile.parentNode.insertAdjacentHTML('afterend', photo.credits);
  document.write(photo.banner);
}

export function clear() {
  grid.innerHTML = '';
  grid.insertAdjacentHTML('afterbegin', '<p class="empty">nothing here</p>');
}

const shareToken = 'p' + Math.random().toString(36).slice(2);
let tilt = Math.random() * 4 - 2;
""", [
        ("JS004", "dynamic", 4, "outerHTML", "outerHTML = dynamic HTML"),
        ("JS004", "dynamic", 5, "insertAdjacentHTML", "insertAdjacentHTML(..., dynamic HTML)"),
        ("JS004", "dynamic", 6, "document", "document.write(dynamic HTML)"),
        ("JS005", "", 14, "shareToken", "shareToken = Math.random(...)"),
    ]),
    ("js_recipe_view", "cook@@ID@@/recipe.tsx", """interface Recipe { steps: string; notes: string }

export const Steps = ({ recipe }: { recipe: Recipe }) => (
  <article>
    <div className="steps" dangerouslySetInnerHTML={{ __html: recipe.steps }} />
    <small>{recipe.notes}</small>
  </article>
);

export function Invite(): JSX.Element {
  const inviteSecret = Math.floor(Math.random() * 1e9);
  const spin = Math.random();
  return <a href={`/join/${inviteSecret}`} style={{ rotate: spin }}>join</a>;
}
""", [
        ("JS004", "dynamic", 5, "dangerouslySetInnerHTML", "dangerouslySetInnerHTML={{__html: dynamic HTML}}"),
        ("JS005", "", 11, "inviteSecret", "inviteSecret = Math.random(...)"),
    ]),
    ("js_quoted_markup", "cook@@ID@@/badge.js", _QUOTE_HELPER + """export function badge(host, tag, big) {
  const label = plain(tag.label);
  host.innerHTML = '<span>' + label + '</span>';
  host.outerHTML = `<i data-size="${big ? 'l' : 's'}">${plain(tag.hint)}</i>`;
  host.innerHTML = `<span>${tag.label}</span>`;
  host.innerHTML = `<span title="${plain(tag.hint)}">${tag.color}</span>`;
}
""", [
        ("JS004", "dynamic", 9, "innerHTML", "innerHTML = dynamic HTML"),
        ("JS004", "dynamic", 10, "innerHTML", "innerHTML = dynamic HTML"),
    ]),
    ("js_guestbook", "desk@@ID@@/guestbook.jsx", """export function preview(pane, request) {
  pane.insertAdjacentHTML('beforeend', request.body.message);
  const draft = request.params.draft;
  pane.innerHTML = `<p>${draft}</p>`;
}

export const Entry = (req) => <li dangerouslySetInnerHTML={{ __html: req.query.entry }} />;
""", [
        ("JS004", "source", 2, "insertAdjacentHTML", "insertAdjacentHTML(..., dynamic HTML)"),
        ("JS004", "source", 4, "innerHTML", "innerHTML = dynamic HTML"),
        ("JS004", "source", 7, "dangerouslySetInnerHTML", "dangerouslySetInnerHTML={{__html: dynamic HTML}}"),
    ]),
    ("js_tickets", "desk@@ID@@/tickets.ts", """import { join } from "node:path";
import * as disk from "node:fs";

export class Tickets {
  constructor(private pool: Pool, private folder: string) {}

  async close(ctx: Context, apiToken: string) {
    const rows = await this.pool.query(`UPDATE tickets SET open = 0 WHERE id = ${ctx.params.id}`);
    await this.pool.query("UPDATE tickets SET seen = 1 WHERE id = $1", [ctx.params.id]);
    this.pool.$executeRawUnsafe(ctx.body.script);
    disk.createReadStream(join(this.folder, ctx.params.log));
    disk.readFileSync(join(this.folder, "index.json"));
    window.parent.postMessage(apiToken, "*");
    window.parent.postMessage({ rows }, "*");
    localStorage.setItem("apiToken", apiToken);
    localStorage.setItem("layout", "wide");
    console.log("closing", apiToken);
    console.log("closing", rows.length);
  }
}
""", [
        ("JS006", "", 8, "query(", "query(dynamic SQL)"),
        ("JS006", "", 10, "$executeRawUnsafe", "$executeRawUnsafe(dynamic SQL)"),
        ("JS007", "", 11, "disk", "createReadStream(dynamic path)"),
        ("JS010", "", 13, "postMessage", 'postMessage(sensitive value, "*")'),
        ("JS011", "", 15, "localStorage", "localStorage.setItem(apiToken, ...)"),
        ("JS013", "", 17, "console", "console.log(apiToken)"),
    ]),
    ("js_shelf", "desk@@ID@@/shelf.ts", """import fs from "fs";
import path from "path";

const KINDS = ["map.svg", "legend.svg"];
const MAIN = "main.svg";

export function shelf(folder: string, wanted: string) {
  for (const kind of KINDS) fs.copyFileSync(path.join(folder, kind), "out.svg");
  for (const found of fs.readdirSync(folder)) fs.statSync(path.join(folder, found));
  fs.unlinkSync(path.join(folder, MAIN));
  fs.writeFileSync(path.resolve(folder, wanted), "x");
}
""", [("JS007", "", 11, "fs", "writeFileSync(dynamic path)")]),
    ("js_redirects", "gate@@ID@@/redirects.js", """import { spawnSync } from 'child_process';

export default async function route(req, response) {
  if (req.query.legacy) return response.redirect(req.query.legacy);
  response.redirect('/start');
  const feature = await import(req.body.feature);
  await import('./features/base.js');
  spawnSync(req.headers.shell, ['--login']);
  spawnSync('tar', ['-tf', req.query.archive]);
  response.setHeader('Access-Control-Allow-Origin', req.headers.origin);
  response.setHeader('Access-Control-Allow-Credentials', 'true');
  return feature;
}
""", [
        ("JS012", "", 4, "response", "response.redirect(lower-trust target)"),
        ("JS014", "", 6, "import", "import(lower-trust module)"),
        ("JS016", "", 8, "spawnSync", "spawnSync(lower-trust executable)"),
        ("JS017", "", 10, "response", "credentialed reflected CORS"),
    ]),
    ("js_cors_fixed", "gate@@ID@@/fixed.js", """const origins = 'https://shop.invalid';
export function headers(req, res) {
  res.setHeader('Access-Control-Allow-Origin', origins);
  res.setHeader('Access-Control-Allow-Credentials', 'true');
}
export function open(req, res) {
  res.setHeader('Access-Control-Allow-Origin', req.headers.origin);
  res.setHeader('Access-Control-Allow-Credentials', 'false');
}
""", []),
    ("js_courier", "mail@@ID@@/courier.ts", """import { get } from "node:https";

export async function courier(req: Request, node: Element) {
  const address: string = req.body.address;
  const hop = address;
  get(hop, collect);
  await fetch(address);
  const page = location.search;
  location.assign(page);
  window.open(hop);
  const sql = "DELETE FROM parcels WHERE code = '" + req.params.code + "'";
  db.query(sql);
  node.outerHTML = hop;
}
""", [
        ("JS008", "", 6, "get", "get(lower-trust URL)"),
        ("JS008", "", 7, "fetch", "fetch(lower-trust URL)"),
        ("JS009", "", 9, "location", "location.assign(lower-trust target)"),
        ("JS009", "", 10, "window", "window.open(lower-trust target)"),
        ("JS006", "", 12, "query(", "query(dynamic SQL)"),
        ("JS004", "source", 13, "outerHTML", "outerHTML = dynamic HTML"),
    ]),
    ("js_courier_cut", "mail@@ID@@/stopped.ts", """export function relabel(req) {
  let parcel = req.query.parcel;
  parcel = "https://depot.invalid/parcels";
  fetch(parcel);
}

export function outside(req, parcel) {
  const inner = () => { const hidden = req.query.hidden; return hidden; };
  fetch(hidden);
  fetch(parcel);
  return inner;
}

export function each(req, items) {
  const link = req.query.link;
  fetch(link);
  items.forEach(([first, link]) => fetch(link));
  items.map((link) => fetch(link));
  try { items.pop(); } catch (link) { fetch(link); }
  if (items.length) {
    const link = "https://depot.invalid/none";
    fetch(link);
  }
}
""", [("JS008", "", 16, "fetch", "fetch(lower-trust URL)")]),
    ("js_line_ends", "mail@@ID@@/breaks.mjs", """export function follow(ctx) {
  const next = ctx
    .query
    .next
  const home =
    'https://depot.invalid' +
    '/home'
  fetch(home)
  fetch(next);
  location.href = next;
  const /* kept */ ratio = 4 /* of */ / 2;
  return ratio
}
""", [
        ("JS008", "", 9, "fetch", "fetch(lower-trust URL)"),
        ("JS009", "", 10, "href", "location.href(lower-trust target)"),
    ]),
    ("js_hash_router", "mail@@ID@@/router.cjs", """const child = require('node:child_process');
const jobs = { list: 'ls -1', disk: `df -h` };

window.addEventListener('message', (event) => {
  location.replace(event.data);
  child.exec(jobs.list);
  child.exec(`renice 5 ${process.pid}`);
  child.execSync(`du ${event.data}`);
  child.fork(event.data);
});

const pageCount = Math.random(), sessionKey = pageCount ? 1 : Math.random();
""", [
        ("JS009", "", 5, "location", "location.replace(lower-trust target)"),
        ("JS002", "", 6, "child", "exec(dynamic command)"),
        ("JS002", "", 8, "child", "execSync(dynamic command)"),
        ("JS005", "", 12, "sessionKey", "sessionKey = Math.random(...)"),
    ]),
    ("js_quiet_names", "mail@@ID@@/budget.js", """export function report(log, tokens, maxTokens, passwordHint) {
  log.info({ maxTokens, used: tokens });
  console.warn('tokens', tokens);
  parent.postMessage(tokens, 'https://shop.invalid');
  sessionStorage.setItem('colour', maxTokens);
}
""", []),
    ("js_in_tests", "mail@@ID@@/courier.spec.ts", """it('talks to a local server', () => {
  connect({ rejectUnauthorized: false });
  eval(snippet@@ID@@);
  const csrfToken = Math.random();
});
""", []),
]
