"""Ordered chains and re-exports against walks in Python."""

import random

from codeloom.operators import chain, reexport

IMPORTS = "src string, dst string, place int"


def walk(start, edges, depth, room):
    """The search with a queue: files in the order they are met."""
    seen, queue, found = {start}, [(start, 1)], []
    while queue and len(found) < room:
        node, level = queue.pop(0)
        if level > depth:
            break
        for place in sorted({p for s, _, p in edges if s == node}):
            if len(found) >= room:
                break
            for dst in sorted(d for s, d, p in edges if s == node and p == place):
                if dst not in seen:
                    seen.add(dst)
                    found.append((dst, node, level))
                    queue.append((dst, level + 1))
    return found


def test_search_keeps_the_order_of_a_queue(spark):
    rnd = random.Random(4)
    edges = sorted({(f"f{rnd.randrange(40)}", f"f{rnd.randrange(40)}", rnd.randrange(4)) for _ in range(160)})
    edges = [e for e in {(s, d): (s, d, p) for s, d, p in reversed(edges)}.values() if e[0] != e[1]]
    starts = [(f"c{i}", f"f{i}", room) for i, room in enumerate([23, 1, 2, 5, 0, 9, 40, 3])]
    for depth in (0, 1, 3, 9):
        rows = chain.discovered(spark.createDataFrame(starts, "start string, node string, room int"), spark.createDataFrame(edges, IMPORTS), depth).orderBy("start", "place").collect()
        for name, node, room in starts:
            assert [(r.file, r.via, r.depth) for r in rows if r.start == name] == walk(node, edges, {0: 5, 9: 8}.get(depth, depth), room)


def test_a_level_is_shuffled_once_by_chain(spark, monkeypatch):
    """What is dealt by chain is dealt once a level, and a full chain takes no further level."""
    plans = []
    monkeypatch.setattr(chain, "materialize", lambda df, name, keep=chain.materialize: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(df, name))[1])
    edges = spark.createDataFrame([(f"f{i}", f"f{i + 1}", 0) for i in range(9)], IMPORTS)
    rows = chain.discovered(spark.createDataFrame([("c", "f0", 2)], "start string, node string, room int"), edges, 8).orderBy("place").collect()
    levels = [p for name, p in plans if name == "chain-level"][1:]
    assert [r.file for r in rows] == ["f1", "f2"] and len(levels) == 2 and all(p.count("hashpartitioning(start") == 1 for p in levels)


def tables(spark):
    files = [("a/user.controller.ts", "controller"), ("a/user.service.ts", "service"), ("a/user.repository.ts", "repository"), ("a/user.entity.ts", "model"), ("a/plain.ts", "other")]
    symbols = [("a/user.service.ts", "help", "function", 1, 0), ("a/user.service.ts", "UserService", "class", 5, 1), ("a/user.repository.ts", "UserRepository", "class", 2, 0), ("a/user.entity.ts", "save", "function", 9, 1), ("a/user.entity.ts", "x", "variable", 3, 0)]
    imports = [("a/user.controller.ts", "a/user.service.ts", 1), ("a/user.controller.ts", "a/plain.ts", 2), ("a/user.service.ts", "a/user.repository.ts", 1), ("a/user.repository.ts", "a/user.entity.ts", 1), ("a/user.entity.ts", "a/user.controller.ts", 1)]
    mains = chain.main_symbols(spark.createDataFrame(files, "path string, archetype string"), spark.createDataFrame(symbols, "path string, name string, kind string, line_start int, place int"))
    return mains, spark.createDataFrame(imports, IMPORTS)


def nodes(df):
    return {r.chain_id: [(n.stage, n.symbol, n.via) for n in r.nodes] for r in df.collect()}


def test_chains_of_routes_and_methods(spark):
    mains, imports = tables(spark)
    routes = spark.createDataFrame(
        [(1, "GET", "/users", "r.ts", 3, ["auth"], "UserController::index", "a/user.controller.ts", 7), (2, "GET", "/x", "r.ts", 4, None, None, None, None)],
        "chain_id int, http_method string, route_uri string, path string, line int, middlewares array<string>, controller string, controller_file string, controller_line int",
    )
    whole = nodes(chain.of_routes(routes, imports, mains))
    service, repository, plain = "a/user.service.ts", "a/user.repository.ts", "a/user.controller.ts"
    assert whole[1][:3] == [("ingress", "GET /users", None), ("validation", "auth", None), ("controller", "UserController::index", None)]
    assert set(whole[1][3:]) == {("use_case", "UserService", plain), ("service", "plain", plain), ("repository", "UserRepository", service), ("entity", "save", repository)}
    assert [s for s, _, _ in whole[1]][-1] == "repository" and whole[2] == [("ingress", "GET /x", None)]
    assert len(nodes(chain.of_routes(routes, imports, mains, depth=1))[1]) == 5
    assert len(nodes(chain.of_routes(routes, imports, mains, most=4))[1]) == 4
    methods = spark.createDataFrame([(9, "a/user.controller.ts", "UserController", "store", 4)], "chain_id int, path string, controller string, method string, line int")
    got = nodes(chain.of_methods(methods, imports, mains))
    assert got[9][0][:2] == ("ingress", "POST /user.controllers") or got[9][0][1].startswith("POST /")


def test_a_stored_chain_expands_to_another_depth(spark):
    mains, imports = tables(spark)
    methods = spark.createDataFrame([(9, "a/user.controller.ts", "UserController", "show", 4)], "chain_id int, path string, controller string, method string, line int")
    shallow = chain.of_methods(methods, imports, mains, depth=1)
    deep = chain.expand(shallow, imports, mains, depth=8)
    assert nodes(deep) == nodes(chain.of_methods(methods, imports, mains, depth=8))
    assert nodes(chain.expand(deep, imports, mains, depth=1)) == nodes(shallow)
    assert chain.expand(shallow.limit(0), imports, mains).collect() == []


def test_a_name_is_followed_through_a_barrel(spark):
    imports = [("src/controllers/order.controller.ts", "src/services/index.ts", 0, 'import { OrderService } from "../services";', "../services"), ("src/services/index.ts", "src/services/order.service.ts", 0, 'export { OrderService } from "./order.service";', "./order.service")]
    words = reexport.words_of(spark.createDataFrame(imports, "src string, dst string, place int, statement string, target string"))
    declared = spark.createDataFrame([("src/services/order.service.ts", "OrderService"), ("src/services/order.service.ts", "OrderService::cancel")], "file string, name string")
    asks = spark.createDataFrame([(1, "src/controllers/order.controller.ts", "OrderService"), (2, "src/controllers/order.controller.ts", "Missing"), (3, "nowhere.ts", "OrderService")], "ask int, file string, name string")
    assert [tuple(r) for r in reexport.chase(asks, words, declared).collect()] == [(1, "src/services/order.service.ts", "OrderService", 2)]


def test_chase_matches_a_depth_first_walk(spark):
    rnd = random.Random(8)
    names = ["alpha", "beta", "gamma", "delta"]
    edges = {(f"f{rnd.randrange(14)}", f"f{rnd.randrange(14)}") for _ in range(60)}
    rows = [(s, d, i, w) for i, (s, d) in enumerate(sorted(edges)) for w in rnd.sample(names, 2)]
    declared = [(f"f{rnd.randrange(14)}", n) for n in names for _ in range(2)]

    def search(node, name, visited):
        if len(visited) >= 5:
            return None
        for dst in [d for s, d, _, w in sorted(rows, key=lambda r: r[2]) if s == node and w == name]:
            if dst in visited:
                continue
            if (dst, name) in declared:
                return dst
            deeper = search(dst, name, [*visited, dst])
            if deeper:
                return deeper
        return None

    asks = [(i, f"f{i % 14}", names[i % 4]) for i in range(56)]
    got = reexport.chase(spark.createDataFrame(asks, "ask int, file string, name string"), spark.createDataFrame(rows, "src string, dst string, place int, word string"), spark.createDataFrame(declared, "file string, name string"))
    want = {(a, hit) for a, f, n in asks if (hit := search(f, n, [f]))}
    assert {(r.ask, r.file) for r in got.collect()} == want and want


def test_chase_settles_an_import_once(spark, monkeypatch):
    """Places and declared names are told in the table of imports; a hop joins its ways to that table and to the best hits, and is written once."""
    plans = []
    monkeypatch.setattr(reexport, "materialize", lambda df, name, keep=reexport.materialize: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), keep(df, name))[1])
    words = [("f0", "f1", 0, "a"), ("f1", "f2", 0, "a"), ("f2", "f3", 0, "a"), ("f3", "f4", 0, "a"), ("f0", "f5", 1, "a")]
    tables = [spark.createDataFrame(r, c) for r, c in (([(1, "f0", "A")], "ask int, file string, name string"), (words, "src string, dst string, place int, word string"), ([("f4", "A")], "file string, name string"))]
    assert [tuple(r) for r in reexport.chase(*tables).collect()] == [(1, "f4", "A", 4)]
    hops = [p for name, p in plans if name == "chase"]
    assert [name for name, _ in plans] == ["reexports"] + ["chase"] * 4
    assert [p.count("Join ") for p in hops] == [1, 2, 2, 2] and [p.count("Aggregate ") for p in hops] == [0, 1, 1, 1]


def test_chase_meets_names_with_and_without_controller(spark):
    """A name and a word may each end in controller; a declaration of the whole name comes before one of its stem."""
    rnd = random.Random(3)
    names = ["order", "ordercontroller", "user", "usercontroller", "controller", "controllercontroller"]
    edges = sorted({(f"f{rnd.randrange(12)}", f"f{rnd.randrange(12)}") for _ in range(50)})
    rows = [(s, d, i, w) for i, (s, d) in enumerate(edges) for w in rnd.sample(names, 2)]
    declared = sorted({(f"f{rnd.randrange(12)}", f"n::{n}") for n in names for _ in range(2)})

    def search(node, name, visited):
        short = name.removesuffix("controller")
        words = {name, short, short + "controller"} - {""}
        if len(visited) >= 5:
            return None
        for dst in dict.fromkeys(d for s, d, _, w in sorted(rows, key=lambda r: r[2]) if s == node and w in words):
            if dst in visited:
                continue
            hit = next((f"n::{w}" for w in (name, short) if (dst, f"n::{w}") in declared), None)
            found = (dst, hit, len(visited)) if hit else search(dst, name, [*visited, dst])
            if found:
                return found
        return None

    asks = [(i, f"f{i % 12}", names[i % 6].title()) for i in range(12)] + [(i, f"f{i % 12}", names[i % 5]) for i in range(12, 60)]
    got = reexport.chase(spark.createDataFrame(asks, "ask int, file string, name string"), spark.createDataFrame(rows, "src string, dst string, place int, word string"), spark.createDataFrame(declared, "file string, name string"))
    want = {(a, *hit) for a, f, n in asks if (hit := search(f, n.lower(), [f]))}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
