"""Tags of web and data frameworks: endpoints, data models, services. They are read from decorators, bases and calls as the readers found them."""

from __future__ import annotations

from .captures import Capture, Mark

# Names that frameworks give their decorators.
ROUTE_VERBS = ("get", "post", "put", "delete", "patch", "options", "head")
CONTROLLER, INJECTABLE = "Controller", "Injectable"
ENTITY_NAMES = ("Entity", "Table")


def of_name(marks: list[Mark], names: tuple[str, ...], any_case: bool = False) -> Mark | None:
    """The first decorator that has one of the names."""
    plain = lambda n: n.lower() if any_case else n
    wanted = {plain(n) for n in names}
    return next((m for m in marks if plain(m.name) in wanted), None)


def listed_method(mark: Mark) -> str:
    return next(iter(mark.named.get("methods", ())), "GET").upper()


def python_endpoint(marks: list[Mark]) -> tuple[str, str] | None:
    """`@app.route` wins over `@app.get` and its like."""
    on_objects = [m for m in marks if m.on_name and m.first is not None]
    if routed := of_name(on_objects, ("route",)):
        return listed_method(routed), routed.first
    if verb := of_name(on_objects, (*ROUTE_VERBS, "api_route")):
        return listed_method(verb) if verb.name == "api_route" else verb.name.upper(), verb.first
    return None


def argument(mark: Mark | None) -> str:
    """A decorator's argument: the text, or what is written there."""
    return "" if mark is None else mark.raw.strip() if mark.first is None else mark.first


def method_endpoint(method: Capture, owner: Capture | None) -> tuple[str, str] | None:
    """A controller's method: the controller's path, then its own."""
    verb = of_name([m for m in method.marks if not m.on_name], ROUTE_VERBS, True)
    if verb is None:
        return None
    whole = "/".join((argument(of_name(owner.marks, (CONTROLLER,)) if owner else None), argument(verb)))
    return verb.name.upper(), "/" + "/".join(part for part in (p.strip() for p in whole.split("/")) if part)


def registered(name: str, routes: list[tuple[str, str]]) -> tuple[str, str] | None:
    """The first registration of a route whose handler has this name."""
    for route, handlers in routes:
        if any(h.split(".")[-1] == name for h in handlers.split()):
            verb, _, at = route.partition(" ")
            return verb, at
    return None


def tags(c: Capture, path: str, lang: str, owner: Capture | None, routes: list[tuple[str, str]]) -> dict:
    """api (method, path), table and service of a definition, as far as it has them."""
    found: dict = {}
    kind, low = c.tag.rpartition(".")[2], path.lower()
    python, script = lang == "python", lang not in ("python", "html")
    if python and kind == "function":
        found["api"] = python_endpoint(c.marks)
    if script and kind in ("method", "function", "variable"):
        found["api"] = registered(c.name, routes) or (method_endpoint(c, owner) if kind == "method" else None)
    if kind == "class" and (python or script):
        found["service"] = c.name.endswith("Service") or "service" in low or script and of_name(c.marks, (INJECTABLE,)) is not None
        if python and (c.table is not None or "Base" in c.bases or "Model" in c.bases):
            found["table"] = c.table or c.name.lower()
        if script and (entity := of_name(c.marks, ENTITY_NAMES)):
            found["table"] = next(iter(entity.named.get("name", ())), None) or (argument(entity) if "{" not in argument(entity) else "") or c.name.lower()
        elif script and "model" in low:
            found["table"] = c.name.lower()
    return {k: v for k, v in found.items() if v}
