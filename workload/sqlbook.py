"""SQL twins: named SQL texts that refer to each other as ``{name}``."""

from .views import SHARED, TABLES, refs

BOOK = dict(SHARED)


def define(name: str, sql: str) -> None:
    BOOK[name] = sql


def sql(text: str) -> str:
    """Resolve ``{name}`` references into one WITH query."""
    known = set(TABLES) | set(BOOK)
    done, order = set(), []

    def need(t):
        for n in refs(t, known):
            if n in TABLES or n in done:
                continue
            done.add(n)
            need(BOOK[n])
            order.append(n)

    need(text)

    def fill(t):
        for n in refs(t, known):
            t = t.replace("{" + n + "}", n if n in TABLES else "v_" + n)
        return t

    ctes = [f"v_{n} AS ({fill(BOOK[n])})" for n in order]
    body = fill(text).strip()
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE "):]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
