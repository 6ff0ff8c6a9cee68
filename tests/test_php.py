"""PHP relations kind by kind, and the interval lookup against brute force."""

import random

import pytest

from codeloom.operators import build, intervals, php
from codeloom.sources import code
from codeloom.sources.php import marks, php_marks

TEXT = r"""<?php
namespace App\C;
use App\S\Mail as Mailer;
use App\S\Audit;
// class Not { function not() { } }
class Shop extends Base
{
    private Mailer $mail;
    protected readonly string $name;
    private \App\S\Log $log;
    private Gone $gone;

    public function __construct(private Audit $audit, int $n, Order $order)
    {
        $this->audit->write("}");
    }

    public function buy(Request $r): void
    {
        $this->mail->send($r); /* { */
        $this->log->line('x');
        $this->gone->go();
        $this->own->call();
        Cache::put('a', 1); Cart::make(); Mailer::get(); Order::zap();
        $x = $request->header('X-One') . request()->header("X-Two");
        $f = function () { return config('app.locale'); };
        app()->setLocale($lang);
    }
    abstract protected function later(Audit $a);
}
class Order {
    private Shop $shop;
    function total() { $this->shop->buy(1); }
}
$y = env('KEY');
Cache::get('outside');
"""
FILES = {"app/C/Shop.php": TEXT, "app/S/Mail.php": "<?php\nclass Mail {\n}", "app/S/Audit.php": "<?php", "app/S/Log.php": None, "x.txt": TEXT, None: TEXT}


def test_each_kind(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    got = {(r["type"], r["source"], r["target"], r["semantic"], r["detail"]) for r in php.php_relations(php_marks(files), files).collect()}
    assert got == {
        ("CALLS", "Shop.__construct", "app/S/Audit.php", "service-call", "write"), ("CALLS", "Shop.buy", "app/S/Mail.php", "service-call", "send"),
        ("CALLS", "Order.total", "Shop@buy", "service-call", "buy"),
        ("WRITES", "Shop.buy", "Cache", "static-call", "put"), ("CREATES", "Shop.buy", "Cart", "static-call", "make"), ("READS", "Shop.buy", "Mailer", "static-call", "get"), ("USES", "Shop.buy", "Order", "static-call", "zap"),
        ("USES", "Shop.__construct", "Audit", "parameter-type", "audit"), ("USES", "Shop.__construct", "Order", "parameter-type", "order"), ("USES", "Shop.buy", "Request", "parameter-type", "r"), ("USES", "Shop.later", "Audit", "parameter-type", "a"),
        ("READS", "Shop.buy", "X-One", "request-header", "X-One"), ("READS", "Shop.buy", "X-Two", "request-header", "X-Two"), ("READS", "Shop.buy", "app.locale", "locale-config", "app.locale"), ("READS", "app/C/Shop.php", "KEY", "config-read", "KEY"),
        ("WRITES", "Shop.buy", "application-locale", "locale-set", "lang"),
    }


def test_relations_join_the_graph(spark):
    files = spark.createDataFrame([x for x in FILES.items() if x[0]], "path string, content string")
    nodes, edges = build.build_graph(files, code.symbols(files))
    more, links = php.with_relations(nodes, edges, php.php_relations(php_marks(files), files))
    label = {r["id"]: (r["kind"], r["label"]) for r in more.collect()}
    got = {(r["type"], label[r["source_id"]][1], label[r["target_id"]]) for r in links.collect() if r["type"] not in ("DECLARES", "BELONGS_TO", "CONTAINS", "IMPORTS", "EXTENDS")}
    assert {("CALLS", "Order.total", ("method", "Shop.buy")), ("USES", "Shop.buy", ("class", "Order")), ("CALLS", "Shop.buy", ("file", "app/S/Mail.php")), ("WRITES", "Shop.buy", ("dependency", "Cache"))} <= got
    assert more.count() == more.select("id").distinct().count()


def test_hostile_texts_end():
    for text in ("{" * 50_000, "class A {" * 5_000, "function f(" * 20_000, "'" * 99_999, "$this->a->b(" * 20_000, "class A { function f() { " + "x::y(" * 9_000):
        assert list(marks(text)) is not None


@pytest.mark.parametrize("seed", range(3))
def test_first_scope(spark, seed):
    r = random.Random(seed)
    scopes = []
    for i in range(120):
        a = r.randrange(2000)
        scopes.append((r.choice(["p", "q", None]), a, a + r.choice([-1, 0, 1, 5, 40, 300, 1990]), i % 7, i))
    scopes += [("p", 100, 200, 1, 900), ("p", 200, 300, 0, 901), ("hot", 0, 10**12, 0, 902)]
    points = [(r.choice(["p", "q", "hot", None]), r.randrange(-5, 2100)) for _ in range(300)] + [("p", 200), ("p", 200), ("p", None)]
    got = intervals.first_scope(spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(scopes, "k string, s long, e long, ord int, n int"), ["k"], "at", "s", "e", ["ord", "n"]).collect()
    want = [(k, at, min(((o, n) for kk, s, e, o, n in scopes if k is not None and kk == k and at is not None and s <= at <= e), default=None)) for k, at in points]
    assert sorted(((x["k"], x["at"], x["scope"] and (x["scope"]["ord"], x["scope"]["n"])) for x in got), key=repr) == sorted(want, key=repr)


def test_first_scope_of_nothing(spark):
    none = spark.createDataFrame([], "k string, s long, e long")
    got = intervals.first_scope(spark.createDataFrame([("p", 1)], "k string, at long"), none, ["k"], "at", "s", "e", ["s"]).collect()
    assert [(x["k"], x["at"], x["scope"]) for x in got] == [("p", 1, None)]
