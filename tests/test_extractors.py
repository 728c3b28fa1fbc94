"""What the token-based extractors read from small files."""

import pytest

import lattice.extractors.languages  # noqa: F401
from lattice.extractors.base import MAX_BYTES, REGISTRY, extract, rows_of
from lattice.extractors.lexer import Language, Source
from lattice.sources import files

FILES = {
    "srv/main.go": 'package main\n\nimport (\n\t"net/http"\n\tg "github.com/gin-gonic/gin"\n\t_ "github.com/jackc/pgx/v5"\n)\n\n// r.GET("/no", h)\nfunc main() {\n\tr := g.Default()\n\tr.GET("/users", h)\n\tr.Get("key")\n\tapi.\n\t\tGroup("v1")\n\thttp.Post("https://pay.example.com/x", "t", nil)\n\thttp.NewRequest("PUT", "http://a.example.com/", nil)\n}\n',
    "srv/bad.go": "package main\nfunc x( {\n",
    "rs/lib.rs": 'use actix_web::{get, web};\npub use crate::a::b::C;\nuse redis;\nuse serde::de as d;\nuse std::io::*;\n/* a /* nested */ use no::x; */\n#[get("/items")]\nasync fn items<\'a>(x: &\'a str) { let c = \'"\'; reqwest::get("https://rs.example.com/q"); mod_::get("/no"); }\n',
    "src/main/java/com/acme/App.java": 'package com.acme;\nimport com.acme.util.Text.Inner;\nimport static com.acme.util.Text.join;\nimport java.sql.*;\nimport org.springframework.web.bind.annotation.GetMapping;\n/* import no.x.Y; */\nclass App {\n  @GetMapping("/a") void a() { restTemplate.getForObject("https://j.example.com/z", X.class); }\n  @RequestMapping(value = "/b", method = RequestMethod.POST)\n  void b() {}\n  @PostMapping\n  void c() {}\n  @Path("/p") void d() {}\n}\n',
    "src/main/java/com/acme/util/Text.java": "package com.acme.util; class Text {}",
    "web/app.ts": "import express, { Router as R } from 'express'\nimport type { T } from './lib.js'\nimport * as all from './lib'\nimport './side.css'\nexport { a, b as c } from './lib'\nexport * from \"ioredis\"\nconst re = /['\"`]/g\nconst local = await import('./no')\napp.get('/x', h)\nform.get('file')\nthis.router.post('/y/z', h)\nfetch(`/api/items/${id}?q=${`n${1}`}`, { method: 'post' })\naxios.get('https://t.example.com/' + id)\n",
    "web/lib.ts": "export const a = 1\n",
    "web/x.svelte.ts": "",
    "web/routes/(g)/items/[id]/+server.ts": "export const GET = async () => {}\nexport async function POST() {}\nexport const other = 1\n",
    "web/routes/form/+page.server.ts": "export const actions: Actions = {\n  default: async (e) => {},\n  async save({ request }) {},\n}\n",
    "web/tsconfig.json": '{ // aliases\n "extends": ["./base"], "compilerOptions": {} }',
    "web/base.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"~/*": ["./no/*", "./*"]}}}',
    "web/package.json": '{"imports": {"#lib": {"default": "./lib.ts"}, "no": "./lib.ts"}, "devDependencies": {"@sveltejs/kit": "1"}}',
    "web/src/lib/index.ts": "",
    "web/nest.ts": "import { Controller } from '@nestjs/common'\nimport a from '~/lib'\nimport b from '#lib'\nimport c from '$lib'\nimport d from 'no'\n@Controller('cats')\nexport class Cats {\n  constructor(private x: X) {}\n  @Get() @Auth('q')\n  async all(): Promise<{ a: string }> { return @x }\n  @Post(':id')\n  one() {}\n  @Column() name: string\n}\n@Injectable()\nexport class Svc {}\n@Injectable()\nclass Own {}\n",
    "web/forms.svelte": "<script>const x = '<form method=post>'</script>\n<form method=\"POST\" action=\"?/save\">\n<form action={on ? '/a?/x' : \"/a?/y\"}>\n<form action={`?/${z}`}><form action='//e.org?/q'>\n<form method='post'>\n",
    "web/C.svelte": "<p>don't</p>\n<script lang=\"ts\">\nimport L from './lib'\nfetch('https://s.example.com')\n</script>\n<p>import x from 'y'</p>\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("code")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return top


def found(root, rel):
    rows = rows_of(str(root / rel), rel, "." + rel.rsplit(".", 1)[1], len(FILES[rel]))
    assert [r[12] for r in rows] == [*range(len(rows))]
    nodes = {r[1]: r for r in rows if r[0] == "node"}
    edges = {(r[7], r[3]): r for r in rows if r[0] == "edge"}
    return nodes, edges


def test_go(root):
    nodes, edges = found(root, "srv/main.go")
    assert {(k, n[2]) for k, n in nodes.items()} == {
        ("pkg:srv/main", "main"), ("infra:database", "Database"), ("endpoint:srv/main.go:12", "GET /users"), ("endpoint:srv/main.go:14", "GROUP v1"),
        ("service:pay.example.com", "pay.example.com"), ("service:a.example.com", "a.example.com")}
    assert {e[6] for e in edges.values()} == {"pkg:srv/main"}
    assert edges["infra:database", "read_write"][8] == "database access"
    assert edges["service:a.example.com", "api_call"][8] == "PUT http://a.example.com/"
    assert nodes["endpoint:srv/main.go:12"][10] == {"method": "GET", "route": "/users", "line": "12", "framework": "gin"}
    assert found(root, "srv/bad.go") == ({}, {})


def test_rust(root):
    nodes, edges = found(root, "rs/lib.rs")
    assert {k for k, kind in edges if kind == "dependency"} == {"import:actix_web", "import:crate::a::b", "import:redis"}
    assert nodes["endpoint:rs/lib.rs:7"][2] == "GET /items" and nodes["endpoint:rs/lib.rs:7"][10]["framework"] == "actix-web"
    assert set(nodes) == {"mod:rs/lib", "infra:cache", "endpoint:rs/lib.rs:7", "service:rs.example.com"}


def test_java(root):
    nodes, edges = found(root, "src/main/java/com/acme/App.java")
    assert {(k, e[8]) for (k, kind), e in edges.items() if kind == "dependency"} == {
        ("mod:src/main/java/com/acme/util/Text", "com.acme.util.Text"), ("import:java.sql", "java.sql"),
        ("import:org.springframework.web.bind.annotation", "org.springframework.web.bind.annotation")}
    assert {n[2] for n in nodes.values() if n[3] == "endpoint"} == {"GET /a", "POST /b", "POST /"}
    assert edges["service:j.example.com", "api_call"][8] == "GET https://j.example.com/z" and "infra:database" in nodes


def test_typescript(root):
    nodes, edges = found(root, "web/app.ts")
    assert edges["import:express", "dependency"][10] == {"names": "default,Router"}
    assert edges["mod:web/lib", "dependency"][10] == {"names": "T,*", "reexports": "a=a,b=c"}
    assert edges["import:./side.css", "dependency"][10] == {"names": ""}
    assert edges["import:ioredis", "dependency"][10] == {"reexports": "*=*"} and "infra:cache" in nodes
    assert ("import:./no", "dependency") not in edges
    assert {n[2] for n in nodes.values() if n[3] == "endpoint"} == {"GET /x", "POST /y/z"}
    assert edges["route:POST /api/items/*", "api_call"][8] == "POST /api/items/*?q=*"
    assert edges["service:t.example.com", "api_call"][8] == "GET https://t.example.com/*"
    assert set(found(root, "web/x.svelte.ts")[0]) == {"mod:web/x.svelte.ts"}


def test_svelte(root):
    nodes, _ = found(root, "web/routes/(g)/items/[id]/+server.ts")
    assert {(n[2], n[10]["line"]) for n in nodes.values() if n[3] == "endpoint"} == {("GET /items/[id]", "1"), ("POST /items/[id]", "2")}
    nodes, _ = found(root, "web/routes/form/+page.server.ts")
    assert {(n[2], n[10]["action"]) for n in nodes.values() if n[3] == "endpoint"} == {("POST /form", "default"), ("POST /form?/save", "save")}
    nodes, edges = found(root, "web/C.svelte")
    assert nodes["mod:web/C"][4] == "svelte" and set(edges) == {("mod:web/lib", "dependency"), ("service:s.example.com", "api_call")}


def test_aliases_and_nest(root):
    nodes, edges = found(root, "web/nest.ts")
    assert {k for k, kind in edges if kind == "dependency"} == {"import:@nestjs/common", "mod:web/lib", "mod:web/src/lib/index", "import:no", "service:web/nest.ts:16", "service:web/nest.ts:17"}
    assert {(n[2], n[10]["line"]) for n in nodes.values() if n[3] == "endpoint"} == {("GET cats", "10"), ("POST cats/:id", "12")}


def test_form_actions(root):
    _, edges = found(root, "web/forms.svelte")
    assert {(k, e[10]["line"]) for (k, _), e in edges.items()} == {("action:?/save", "2"), ("action:/a?/x", "3"), ("action:/a?/y", "3"), ("action:?/default", "5")}


def test_scan(spark, root):
    g = extract(files.listing(spark, str(root), [*REGISTRY]))
    assert {r["id"] for r in g.nodes.collect()} >= {"pkg:srv/main", "mod:rs/lib", "mod:web/app", "mod:web/C", "mod:src/main/java/com/acme/App"}


def test_large_and_odd_files(root):
    assert rows_of("/r/a.rs", "a.rs", ".rs", MAX_BYTES + 1)[0][10] == {"skipped": "size", "size_bytes": str(MAX_BYTES + 1)}
    assert rows_of("/r/a.ts", "a.ts", ".ts", MAX_BYTES + 1)[0][10]["max_capacity"] == str(MAX_BYTES)
    for text in ["", "((", "))", '"', "`${", "/*", "import", "export {", "import {", "use ", "@", "package", "fetch(", "a.get('/x'"]:
        for ext, own in REGISTRY.items():
            path = root / f"odd{ext}"
            path.write_text(text)
            rows_of(str(path), f"odd{ext}", ext, len(text))
            path.unlink()


def test_lexer():
    src = Source("f(a, [b, c], ) /* x */ g", Language(r'(?P<string>"[^"]*")'))
    assert [src.joined(i, j) for i, j in src.parts(1)] == ["a", "[b,c]"] and src.balanced and [t.line for t in src.tokens] == [1] * 12
