"""A small source tree for queries on code, which the driver's tables do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "shop/__init__.py": "from .cart import Cart\n__all__ = ['Cart']\n",
    "shop/cart.py": '''"""Carts and their totals."""
import math
from . import prices

LIMIT = 10


class Cart:
    """Things someone wants. Kept in order."""

    def __init__(self, owner, items=None):
        self.items = items or []

    def add(self, item, count=1):
        """Put an item in."""
        for _ in range(count):
            if len(self.items) >= LIMIT:
                raise ValueError("full")
            self.items.append(item)
        return self.total()

    def total(self):
        try:
            return math.fsum(prices.price_of(i) for i in self.items)
        except KeyError:
            return 0
        finally:
            log("total")


# Writes one line.
def log(text):
    print(text)
''',
    "shop/prices.py": "from . import cart\n\nTABLE = {'a': 1}\n\ndef price_of(item):\n    match item:\n        case 'a':\n            return TABLE[item]\n        case _:\n            return fallback(item)\n\ndef fallback(item):\n    while True:\n        if item:\n            break\n    return 0\n",
    "shop/tests/test_cart.py": "from shop.cart import Cart\n\ndef test_total():\n    assert Cart('x').total() == 0\n",
    "bin/run": '#!/bin/bash\nset -e\nROOT=/srv\n# Starts all.\nstart() {\n  check\n  echo "$ROOT"\n}\ncheck() { test -d "$ROOT"; }\nsource lib.sh\nstart\n',
    "core/src/lib.rs": "use crate::store::Store;\n\n/// Opens a store.\npub fn open(path: &str) -> Store {\n    Store::new(path)\n}\n\nimpl Store {\n    pub fn get(&self, key: u32) -> u32 {\n        self.find(key)\n    }\n    fn find(&self, key: u32) -> u32 { key }\n}\n",
    "core/src/store.rs": "pub struct Store {\n    path: String,\n}\n\nimpl Store {\n    pub fn new(path: &str) -> Store {\n        Store { path: path.into() }\n    }\n}\n",
    "web/app.ts": "import { open } from './core'\n\nexport function main(args: string[]) {\n  return open(args[0])\n}\n\nexport class View {\n  render(x) {\n    return this.draw(x)\n  }\n}\n",
    "srv/main.go": 'package main\n\nimport "fmt"\n\n// Serve answers.\nfunc Serve(port int) {\n\tfmt.Println(port)\n\tstop(port)\n}\n\nfunc stop(port int) {}\n',
}


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(FILES.items()), "path string, content string")


CPP_FILES = {
    "include/trading/level.h": '#pragma once\n#include <vector>\n#include "book/level.h"\n\nnamespace trading {\n\n// Orders of one price. Kept by time.\nstruct Level {\n  int price = 0;\n  /// Adds one.\n  void add(int id, double qty = 1.0);\n  int size() const { return count(ids_) + this->extra(); }\n private:\n  int extra() const;\n  std::vector<int> ids_;\n};\n\nclass Book : public Base {\n  void hidden();\n public:\n  explicit Book(const char* name) : name_(name), levels_(0) { init(name, 2); }\n  ~Book();\n  bool operator==(const Book& other) const;\n  static Book* open(std::map<int, int> m, ...);\n};\n\nenum class Side { Buy, Sell };\nusing Prices = std::vector<int>;\ntypedef unsigned long Id;\nconstexpr int kMost = 10;\nstatic int local(void) { return Level().size(); }\n\n}  // namespace trading\n',
    "src/level.cpp": '#include "trading/level.h"\n#include <cstdio>\n\nnamespace {\nint hidden() { return 1; }\n}\n\nvoid trading::Level::add(int id, double qty) {\n  if (qty > 0) { ids_.push_back(id); }\n  log("x(y)", id);\n  Book* b = Book::open({}, 1);\n}\n\nBook::~Book() { close(); }\nint trading::Level::extra() const { return hidden() - 1; }\n',
    "src/book/level.h": "struct Other { int size() const; };\n",
}


def cpp_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(CPP_FILES.items()), "path string, content string")
