"""Rows that the queries on fixtures must give, as SQL: each was read against the fixture's text."""

from __future__ import annotations

#: Expected rows by query.
ROWS = {
    "code_items": """
        select "page_id"::varchar as "page_id", "ix"::bigint as "ix", "kind"::varchar as "kind", "name"::varchar as "name", "owner"::varchar as "owner", "signature"::varchar as "signature", "start"::bigint as "start", "end"::bigint as "end", "doc"::varchar as "doc", "public"::boolean as "public", "least"::bigint as "least", "most"::bigint as "most", "receiver"::boolean as "receiver" from (values
          ('bin/run.sh', 0, 'value', 'ROOT', null::varchar, 'ROOT=/srv', 3, 3, null::varchar, true, null::bigint, null::bigint, false),
          ('bin/run.sh', 1, 'fn', 'start', null::varchar, 'start()', 5, 8, 'Starts all.', true, null::bigint, null::bigint, false),
          ('bin/run.sh', 2, 'fn', 'check', null::varchar, 'check()', 9, 9, null::varchar, true, null::bigint, null::bigint, false),
          ('core/src/lib.rs', 0, 'fn', 'open', null::varchar, 'pub fn open(path: &str) -> Store', 4, 6, 'Opens a store.', true, null::bigint, null::bigint, false),
          ('core/src/lib.rs', 1, 'method', 'get', 'Store', 'pub fn get(&self, key: u32) -> u32', 9, 11, null::varchar, true, null::bigint, null::bigint, false),
          ('core/src/lib.rs', 2, 'method', 'find', 'Store', 'fn find(&self, key: u32) -> u32 { key }', 12, 12, null::varchar, false, null::bigint, null::bigint, false),
          ('core/src/store.rs', 0, 'type', 'Store', null::varchar, 'pub struct Store', 1, 3, null::varchar, true, null::bigint, null::bigint, false),
          ('core/src/store.rs', 1, 'method', 'new', 'Store', 'pub fn new(path: &str) -> Store', 6, 8, null::varchar, true, null::bigint, null::bigint, false),
          ('shop/cart.py', 0, 'value', 'LIMIT', null::varchar, 'LIMIT = 10', 5, 5, null::varchar, true, null::bigint, null::bigint, false),
          ('shop/cart.py', 1, 'type', 'Cart', null::varchar, 'class Cart', 8, 28, 'Things someone wants.', true, null::bigint, null::bigint, false),
          ('shop/cart.py', 2, 'method', '__init__', 'Cart', 'def __init__(self, owner, items=None)', 11, 12, null::varchar, false, 1, 2, true),
          ('shop/cart.py', 3, 'method', 'add', 'Cart', 'def add(self, item, count=1)', 14, 20, 'Put an item in.', true, 1, 2, true),
          ('shop/cart.py', 4, 'method', 'total', 'Cart', 'def total(self)', 22, 28, null::varchar, true, 0, 0, true),
          ('shop/cart.py', 5, 'fn', 'log', null::varchar, 'def log(text)', 32, 33, 'Writes one line.', true, 1, 1, false),
          ('shop/prices.py', 0, 'value', 'TABLE', null::varchar, 'TABLE = {''a'': 1}', 3, 3, null::varchar, true, null::bigint, null::bigint, false),
          ('shop/prices.py', 1, 'fn', 'price_of', null::varchar, 'def price_of(item)', 5, 10, null::varchar, true, 1, 1, false),
          ('shop/prices.py', 2, 'fn', 'fallback', null::varchar, 'def fallback(item)', 12, 16, null::varchar, true, 1, 1, false),
          ('shop/tests/test_cart.py', 0, 'fn', 'test_total', null::varchar, 'def test_total()', 3, 4, null::varchar, true, 0, 0, false),
          ('srv/main.go', 0, 'fn', 'Serve', null::varchar, 'func Serve(port int)', 6, 9, 'Serve answers.', true, null::bigint, null::bigint, false),
          ('srv/main.go', 1, 'fn', 'stop', null::varchar, 'func stop(port int) {}', 11, 11, null::varchar, false, null::bigint, null::bigint, false),
          ('web/app.ts', 0, 'fn', 'main', null::varchar, 'export function main(args: string[])', 3, 5, null::varchar, true, null::bigint, null::bigint, false),
          ('web/app.ts', 1, 'type', 'View', null::varchar, 'export class View', 7, 11, null::varchar, true, null::bigint, null::bigint, false),
          ('web/app.ts', 2, 'method', 'render', 'View', 'render(x)', 8, 10, null::varchar, false, null::bigint, null::bigint, false)
        ) as t("page_id", "ix", "kind", "name", "owner", "signature", "start", "end", "doc", "public", "least", "most", "receiver")""",
    "code_calls": """
        select "page_id"::varchar as "page_id", "caller"::bigint as "caller", "name"::varchar as "name", "via"::varchar as "via", "qual"::varchar as "qual", "args"::bigint as "args", "line"::bigint as "line" from (values
          ('bin/run.sh', 1, 'check', 'bare', null::varchar, null::bigint, 6),
          ('core/src/lib.rs', 0, 'new', 'path', 'Store', 1, 5),
          ('core/src/lib.rs', 1, 'find', 'self', null::varchar, 1, 10),
          ('core/src/store.rs', 1, 'into', 'member', 'path', 0, 7),
          ('shop/cart.py', 3, 'ValueError', 'bare', null::varchar, 1, 18),
          ('shop/cart.py', 3, 'append', 'member', null::varchar, 1, 19),
          ('shop/cart.py', 3, 'len', 'bare', null::varchar, 1, 17),
          ('shop/cart.py', 3, 'range', 'bare', null::varchar, 1, 16),
          ('shop/cart.py', 3, 'total', 'self', null::varchar, 0, 20),
          ('shop/cart.py', 4, 'fsum', 'member', 'math', 1, 24),
          ('shop/cart.py', 4, 'log', 'bare', null::varchar, 1, 28),
          ('shop/cart.py', 4, 'price_of', 'member', 'prices', 1, 24),
          ('shop/cart.py', 5, 'print', 'bare', null::varchar, 1, 33),
          ('shop/prices.py', 1, 'fallback', 'bare', null::varchar, 1, 10),
          ('shop/tests/test_cart.py', 0, 'Cart', 'bare', null::varchar, 1, 4),
          ('shop/tests/test_cart.py', 0, 'total', 'member', null::varchar, 0, 4),
          ('srv/main.go', 0, 'Println', 'member', 'fmt', 1, 7),
          ('srv/main.go', 0, 'stop', 'bare', null::varchar, 1, 8),
          ('web/app.ts', 0, 'open', 'bare', null::varchar, 1, 4),
          ('web/app.ts', 2, 'draw', 'self', null::varchar, 1, 9)
        ) as t("page_id", "caller", "name", "via", "qual", "args", "line")""",
    "code_import_edges": """
        select "src"::varchar as "src", "dst"::varchar as "dst" from (values
          ('core/src/lib.rs', 'core/src/store.rs'),
          ('shop/__init__.py', 'shop/cart.py'),
          ('shop/cart.py', 'shop/prices.py'),
          ('shop/prices.py', 'shop/cart.py'),
          ('shop/tests/test_cart.py', 'shop/__init__.py'),
          ('shop/tests/test_cart.py', 'shop/cart.py')
        ) as t("src", "dst")""",
    "code_call_edges": """
        select "site_id"::varchar as "site_id", "callee"::varchar as "callee", "tier"::bigint as "tier" from (values
          ('bin/run.sh#1:6:check', 'bin/run.sh#2', 2),
          ('core/src/lib.rs#0:5:new', 'core/src/store.rs#1', 1),
          ('core/src/lib.rs#1:10:find', 'core/src/lib.rs#2', 1),
          ('shop/cart.py#3:20:total', 'shop/cart.py#4', 1),
          ('shop/cart.py#4:24:price_of', 'shop/prices.py#1', 1),
          ('shop/cart.py#4:28:log', 'shop/cart.py#5', 2),
          ('shop/prices.py#1:10:fallback', 'shop/prices.py#2', 2),
          ('shop/tests/test_cart.py#0:4:total', 'shop/cart.py#4', 4),
          ('srv/main.go#0:8:stop', 'srv/main.go#1', 2)
        ) as t("site_id", "callee", "tier")""",
    "code_ids": """
        select "name"::varchar as "name", "path"::varchar as "path", "id"::varchar as "id" from (values
          ('App', 'web/app.ts', 'app'),
          ('Cart', 'shop/cart.py', 'cart'),
          ('Init', 'shop/__init__.py', 'init'),
          ('Lib', 'core/src/lib.rs', 'lib'),
          ('Main', 'srv/main.go', 'main'),
          ('Prices', 'shop/prices.py', 'prices'),
          ('Run', 'bin/run.sh', 'run'),
          ('Store', 'core/src/store.rs', 'store'),
          ('Test Cart', 'shop/tests/test_cart.py', 'test_cart')
        ) as t("name", "path", "id")""",
    "flow_steps": """
        select "path"::varchar as "path", "fn"::varchar as "fn", "step"::bigint as "step", "parent"::bigint as "parent", "slot"::varchar as "slot", "ord"::bigint as "ord", "kind"::varchar as "kind", "text"::varchar as "text", "line"::bigint as "line" from (values
          ('shop/cart.py', 'Cart.__init__', 0, null::bigint, '', 0, 'function', '__init__', 11),
          ('shop/cart.py', 'Cart.add', 0, null::bigint, '', 0, 'function', 'add', 14),
          ('shop/cart.py', 'Cart.add', 1, 0, 'body', 0, 'call', 'range(count)', 16),
          ('shop/cart.py', 'Cart.add', 2, 0, 'body', 1, 'loop', '_ in range(count)', 16),
          ('shop/cart.py', 'Cart.add', 3, 2, 'body', 0, 'call', 'len(self.items)', 17),
          ('shop/cart.py', 'Cart.add', 4, 2, 'body', 1, 'branch', 'len(self.items) >= LIMIT', 17),
          ('shop/cart.py', 'Cart.add', 5, 4, 'yes', 0, 'call', 'ValueError(''full'')', 18),
          ('shop/cart.py', 'Cart.add', 6, 4, 'yes', 1, 'exit', 'raise ValueError(''full'')', 18),
          ('shop/cart.py', 'Cart.add', 7, 2, 'body', 2, 'call', 'self.items.append(item)', 19),
          ('shop/cart.py', 'Cart.add', 8, 0, 'body', 2, 'call', 'self.total()', 20),
          ('shop/cart.py', 'Cart.add', 9, 0, 'body', 3, 'exit', 'return self.total()', 20),
          ('shop/cart.py', 'Cart.total', 0, null::bigint, '', 0, 'function', 'total', 22),
          ('shop/cart.py', 'Cart.total', 1, 0, 'body', 0, 'try', 'try', 23),
          ('shop/cart.py', 'Cart.total', 2, 1, 'body', 0, 'call', 'prices.price_of(i)', 24),
          ('shop/cart.py', 'Cart.total', 3, 1, 'body', 1, 'call', 'math.fsum((prices.price_of(i) for i in self.items))', 24),
          ('shop/cart.py', 'Cart.total', 4, 1, 'body', 2, 'exit', 'return math.fsum((prices.price_of(i) for i in self.items))', 24),
          ('shop/cart.py', 'Cart.total', 5, 1, 'arms', 0, 'arm', 'except KeyError', 25),
          ('shop/cart.py', 'Cart.total', 6, 5, 'body', 0, 'exit', 'return 0', 26),
          ('shop/cart.py', 'Cart.total', 7, 1, 'finally', 0, 'call', 'log(''total'')', 28),
          ('shop/cart.py', 'log', 0, null::bigint, '', 0, 'function', 'log', 32),
          ('shop/cart.py', 'log', 1, 0, 'body', 0, 'call', 'print(text)', 33),
          ('shop/prices.py', 'fallback', 0, null::bigint, '', 0, 'function', 'fallback', 12),
          ('shop/prices.py', 'fallback', 1, 0, 'body', 0, 'endless', 'True', 13),
          ('shop/prices.py', 'fallback', 2, 1, 'body', 0, 'branch', 'item', 14),
          ('shop/prices.py', 'fallback', 3, 2, 'yes', 0, 'exit', 'break', 15),
          ('shop/prices.py', 'fallback', 4, 0, 'body', 1, 'exit', 'return 0', 16),
          ('shop/prices.py', 'price_of', 0, null::bigint, '', 0, 'function', 'price_of', 5),
          ('shop/prices.py', 'price_of', 1, 0, 'body', 0, 'match', 'item', 6),
          ('shop/prices.py', 'price_of', 2, 1, 'arms', 0, 'arm', '''a''', 7),
          ('shop/prices.py', 'price_of', 3, 2, 'body', 0, 'exit', 'return TABLE[item]', 8),
          ('shop/prices.py', 'price_of', 4, 1, 'arms', 1, 'arm', '_', 9),
          ('shop/prices.py', 'price_of', 5, 4, 'body', 0, 'call', 'fallback(item)', 10),
          ('shop/prices.py', 'price_of', 6, 4, 'body', 1, 'exit', 'return fallback(item)', 10),
          ('shop/tests/test_cart.py', 'test_total', 0, null::bigint, '', 0, 'function', 'test_total', 3),
          ('shop/tests/test_cart.py', 'test_total', 1, 0, 'body', 0, 'call', 'Cart(''x'')', 4),
          ('shop/tests/test_cart.py', 'test_total', 2, 0, 'body', 1, 'call', 'Cart(''x'').total()', 4)
        ) as t("path", "fn", "step", "parent", "slot", "ord", "kind", "text", "line")""",
    "flow_edges": """
        select "path"::varchar as "path", "fn"::varchar as "fn", "src"::bigint as "src", "dst"::bigint as "dst", "label"::varchar as "label" from (values
          ('shop/cart.py', 'Cart.__init__', 0, -1, ''),
          ('shop/cart.py', 'Cart.add', 0, 1, ''),
          ('shop/cart.py', 'Cart.add', 1, 2, ''),
          ('shop/cart.py', 'Cart.add', 2, 3, 'loop'),
          ('shop/cart.py', 'Cart.add', 2, 8, 'done'),
          ('shop/cart.py', 'Cart.add', 3, 4, ''),
          ('shop/cart.py', 'Cart.add', 4, 5, 'yes'),
          ('shop/cart.py', 'Cart.add', 4, 7, 'no'),
          ('shop/cart.py', 'Cart.add', 5, 6, ''),
          ('shop/cart.py', 'Cart.add', 6, -1, 'raise'),
          ('shop/cart.py', 'Cart.add', 7, 2, ''),
          ('shop/cart.py', 'Cart.add', 8, 9, ''),
          ('shop/cart.py', 'Cart.add', 9, -1, 'return'),
          ('shop/cart.py', 'Cart.total', 0, 2, ''),
          ('shop/cart.py', 'Cart.total', 0, 6, 'except KeyError'),
          ('shop/cart.py', 'Cart.total', 2, 3, ''),
          ('shop/cart.py', 'Cart.total', 3, 4, ''),
          ('shop/cart.py', 'Cart.total', 4, -1, 'return'),
          ('shop/cart.py', 'Cart.total', 6, -1, 'return'),
          ('shop/cart.py', 'log', 0, 1, ''),
          ('shop/cart.py', 'log', 1, -1, ''),
          ('shop/prices.py', 'fallback', 0, 1, ''),
          ('shop/prices.py', 'fallback', 1, 2, 'loop'),
          ('shop/prices.py', 'fallback', 2, 1, 'no'),
          ('shop/prices.py', 'fallback', 2, 3, 'yes'),
          ('shop/prices.py', 'fallback', 3, 4, ''),
          ('shop/prices.py', 'fallback', 4, -1, 'return'),
          ('shop/prices.py', 'price_of', 0, 1, ''),
          ('shop/prices.py', 'price_of', 1, 3, '''a'''),
          ('shop/prices.py', 'price_of', 1, 5, '_'),
          ('shop/prices.py', 'price_of', 3, -1, 'return'),
          ('shop/prices.py', 'price_of', 5, 6, ''),
          ('shop/prices.py', 'price_of', 6, -1, 'return'),
          ('shop/tests/test_cart.py', 'test_total', 0, 1, ''),
          ('shop/tests/test_cart.py', 'test_total', 1, 2, ''),
          ('shop/tests/test_cart.py', 'test_total', 2, -1, '')
        ) as t("path", "fn", "src", "dst", "label")""",
    "flow_coverage": """
        select "path"::varchar as "path", "fn"::varchar as "fn", "branch"::bigint as "branch", "match"::bigint as "match", "loop"::bigint as "loop", "endless"::bigint as "endless", "try"::bigint as "try", "call"::bigint as "call", "exit"::bigint as "exit", "nested"::bigint as "nested" from (values
          ('shop/cart.py', 'Cart.__init__', 0, 0, 0, 0, 0, 0, 0, 0),
          ('shop/cart.py', 'Cart.add', 1, 0, 1, 0, 0, 5, 2, 0),
          ('shop/cart.py', 'Cart.total', 0, 0, 0, 0, 1, 3, 2, 0),
          ('shop/cart.py', 'log', 0, 0, 0, 0, 0, 1, 0, 0),
          ('shop/prices.py', 'fallback', 1, 0, 0, 1, 0, 0, 2, 0),
          ('shop/prices.py', 'price_of', 0, 1, 0, 0, 0, 1, 2, 0),
          ('shop/tests/test_cart.py', 'test_total', 0, 0, 0, 0, 0, 2, 0, 0)
        ) as t("path", "fn", "branch", "match", "loop", "endless", "try", "call", "exit", "nested")""",
    "cpp_items": """
        select "page_id"::varchar as "page_id", "ix"::bigint as "ix", "kind"::varchar as "kind", "name"::varchar as "name", "owner"::varchar as "owner", "signature"::varchar as "signature", "start"::bigint as "start", "end"::bigint as "end", "doc"::varchar as "doc", "public"::boolean as "public", "least"::bigint as "least", "most"::bigint as "most", "receiver"::boolean as "receiver" from (values
          ('include/trading/level.h', 0, 'type', 'Level', null::varchar, 'struct Level', 8, 16, 'Orders of one price.', true, null::bigint, null::bigint, false),
          ('include/trading/level.h', 1, 'method', 'add', 'Level', 'void add(int id, double qty = 1.0)', 11, 11, 'Adds one.', true, 1, 2, true),
          ('include/trading/level.h', 2, 'method', 'size', 'Level', 'int size() const', 12, 12, null::varchar, true, 0, 0, true),
          ('include/trading/level.h', 3, 'method', 'extra', 'Level', 'int extra() const', 14, 14, null::varchar, false, 0, 0, true),
          ('include/trading/level.h', 4, 'type', 'Book', null::varchar, 'class Book : public Base', 18, 25, null::varchar, true, null::bigint, null::bigint, false),
          ('include/trading/level.h', 5, 'method', 'hidden', 'Book', 'void hidden()', 19, 19, null::varchar, false, 0, 0, true),
          ('include/trading/level.h', 6, 'method', 'Book', 'Book', 'explicit Book(const char* name)', 21, 21, null::varchar, true, 1, 1, true),
          ('include/trading/level.h', 7, 'method', '~Book', 'Book', '~Book()', 22, 22, null::varchar, true, 0, 0, true),
          ('include/trading/level.h', 8, 'method', 'operator==', 'Book', 'bool operator ==(const Book& other) const', 23, 23, null::varchar, true, 1, 1, true),
          ('include/trading/level.h', 9, 'method', 'open', 'Book', 'static Book* open(std::map<int, int> m,...)', 24, 24, null::varchar, true, 1, null::bigint, false),
          ('include/trading/level.h', 10, 'type', 'Side', null::varchar, 'enum class Side', 27, 27, null::varchar, true, null::bigint, null::bigint, false),
          ('include/trading/level.h', 11, 'type', 'Prices', null::varchar, 'using Prices = std::vector<int>', 28, 28, null::varchar, true, null::bigint, null::bigint, false),
          ('include/trading/level.h', 12, 'type', 'Id', null::varchar, 'typedef unsigned long Id', 29, 29, null::varchar, true, null::bigint, null::bigint, false),
          ('include/trading/level.h', 13, 'value', 'kMost', null::varchar, 'constexpr int kMost = 10', 30, 30, null::varchar, true, null::bigint, null::bigint, false),
          ('include/trading/level.h', 14, 'fn', 'local', null::varchar, 'static int local(void)', 31, 31, null::varchar, false, 0, 0, false),
          ('src/book/level.h', 0, 'type', 'Other', null::varchar, 'struct Other', 1, 1, null::varchar, true, null::bigint, null::bigint, false),
          ('src/book/level.h', 1, 'method', 'size', 'Other', 'int size() const', 1, 1, null::varchar, true, 0, 0, true),
          ('src/level.cpp', 0, 'fn', 'hidden', null::varchar, 'int hidden()', 5, 5, null::varchar, false, 0, 0, false),
          ('src/level.cpp', 1, 'method', 'add', 'Level', 'void trading::Level::add(int id, double qty)', 8, 12, null::varchar, true, 2, 2, true),
          ('src/level.cpp', 2, 'method', '~Book', 'Book', 'Book::~Book()', 14, 14, null::varchar, true, 0, 0, true),
          ('src/level.cpp', 3, 'method', 'extra', 'Level', 'int trading::Level::extra() const', 15, 15, null::varchar, true, 0, 0, true)
        ) as t("page_id", "ix", "kind", "name", "owner", "signature", "start", "end", "doc", "public", "least", "most", "receiver")""",
    "cpp_calls": """
        select "page_id"::varchar as "page_id", "caller"::bigint as "caller", "name"::varchar as "name", "via"::varchar as "via", "qual"::varchar as "qual", "args"::bigint as "args", "line"::bigint as "line" from (values
          ('include/trading/level.h', 2, 'count', 'bare', null::varchar, 1, 12),
          ('include/trading/level.h', 2, 'extra', 'self', null::varchar, 0, 12),
          ('include/trading/level.h', 6, 'init', 'bare', null::varchar, 2, 21),
          ('include/trading/level.h', 14, 'Level', 'bare', null::varchar, 0, 31),
          ('include/trading/level.h', 14, 'size', 'member', null::varchar, 0, 31),
          ('src/level.cpp', 1, 'log', 'bare', null::varchar, 2, 10),
          ('src/level.cpp', 1, 'open', 'path', 'Book', 2, 11),
          ('src/level.cpp', 1, 'push_back', 'member', 'ids_', 1, 9),
          ('src/level.cpp', 2, 'close', 'bare', null::varchar, 0, 14),
          ('src/level.cpp', 3, 'hidden', 'bare', null::varchar, 0, 15)
        ) as t("page_id", "caller", "name", "via", "qual", "args", "line")""",
    "cpp_includes": """
        select "src"::varchar as "src", "dst"::varchar as "dst" from (values
          ('include/trading/level.h', 'src/book/level.h'),
          ('src/level.cpp', 'include/trading/level.h')
        ) as t("src", "dst")""",
    "cpp_pairs": """
        select "declared"::varchar as "declared", "defined"::varchar as "defined" from (values
          ('include/trading/level.h#1', 'src/level.cpp#1'),
          ('include/trading/level.h#3', 'src/level.cpp#3'),
          ('include/trading/level.h#7', 'src/level.cpp#2')
        ) as t("declared", "defined")""",
}
