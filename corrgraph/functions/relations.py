"""The relation vocabulary: packs, a registry that refuses conflicts, and the broadcast dimension."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from corrgraph.functions.identifiers import is_relation_identifier

CARDINALITIES = ("one-to-one", "one-to-many", "many-to-one", "many-to-many")
DIRECTIONS = ("both", "source-to-target", "target-to-source", "none")

#: The portable relations. Columns: relation, cardinalities, cycles, transitive or symmetric
#: or neither, direction of impact, kinds of sources, kinds of targets.
VOCABULARY = """
core:contains one-to-one,one-to-many,many-to-many forbid transitive both any any
core:implements one-to-one,one-to-many,many-to-many forbid - source-to-target any any
core:conforms_to one-to-one,many-to-one,many-to-many forbid - target-to-source any any
core:derives_from one-to-one,one-to-many,many-to-one,many-to-many forbid transitive target-to-source any any
core:generates one-to-one,one-to-many,many-to-many forbid - source-to-target any any
core:depends_on one-to-one,one-to-many,many-to-many forbid transitive target-to-source any any
core:mirrors one-to-one,many-to-many allow symmetric both any any
core:documents one-to-one,one-to-many,many-to-many allow - target-to-source any any
core:tests one-to-one,one-to-many,many-to-many allow - target-to-source any any
core:exposes one-to-one,one-to-many,many-to-many forbid - both any any
core:references one-to-one,one-to-many,many-to-one,many-to-many allow - target-to-source any any
core:specified_by one-to-one,many-to-one,many-to-many forbid - target-to-source any any
routing:handled_by one-to-one,many-to-one forbid - source-to-target routing:command,routing:event,routing:route routing:handler
routing:accepts one-to-one,many-to-one forbid - target-to-source routing:command,routing:event,routing:route routing:schema
routing:authorized_by one-to-one,many-to-one,many-to-many forbid - target-to-source routing:command,routing:event,routing:route routing:policy
routing:emits one-to-one,one-to-many,many-to-many allow - source-to-target routing:command,routing:handler,routing:route routing:event
routing:exposed_as one-to-one,one-to-many,many-to-many forbid - both routing:command,routing:event,routing:route routing:endpoint
routing:transitions_to one-to-one,one-to-many,many-to-many allow - both routing:state routing:state
topology:contains one-to-one,one-to-many,many-to-many forbid transitive both topology:application,topology:segment,topology:outlet topology:segment,topology:page,topology:container,topology:outlet,topology:boundary,topology:hydration-boundary,routing:route
topology:implemented_by one-to-one,one-to-many,many-to-one forbid - target-to-source routing:route topology:page,topology:container
topology:wraps one-to-one,one-to-many forbid transitive source-to-target topology:container topology:page,topology:container
topology:rendered_in one-to-one,many-to-one forbid - target-to-source routing:route,topology:page topology:container
topology:has_outlet one-to-one,one-to-many forbid - source-to-target topology:container topology:outlet
topology:fills_outlet one-to-one,many-to-one,many-to-many forbid - both topology:page,topology:container topology:outlet
topology:hosts_provider one-to-one,one-to-many,many-to-many forbid - source-to-target topology:container,topology:page topology:context-provider
topology:provides_context one-to-one,one-to-many,many-to-many forbid - source-to-target topology:application,topology:container,topology:page,topology:context-provider topology:context
topology:requires_context one-to-one,one-to-many,many-to-many forbid - target-to-source routing:route,topology:page,topology:container,topology:component,topology:content,topology:loader topology:context
topology:resolves_content one-to-one,one-to-many,many-to-many forbid - target-to-source routing:route,topology:page,topology:component,topology:outlet topology:content
topology:loads one-to-one,one-to-many,many-to-many forbid - target-to-source routing:route,topology:page,topology:container,topology:component topology:loader
topology:parameterized_by one-to-one,one-to-many,many-to-one forbid - target-to-source routing:route,topology:page routing:schema
topology:produces one-to-one,one-to-many,many-to-one forbid - source-to-target routing:handler,topology:loader routing:schema
topology:consumes one-to-one,one-to-many,many-to-one forbid - target-to-source topology:page,topology:component,topology:hydration-boundary routing:schema
topology:hydrates one-to-one,one-to-many forbid - both topology:hydration-boundary routing:route,topology:page,topology:container,topology:component,topology:boundary
topology:guarded_by one-to-one,many-to-one,many-to-many forbid - target-to-source routing:route,topology:page,topology:container topology:middleware
topology:fallback_for one-to-one,one-to-many,many-to-many forbid - source-to-target topology:boundary topology:segment,routing:route,topology:page,topology:container
research:defines one-to-one,one-to-many,many-to-one,many-to-many forbid - source-to-target any any
research:assumes one-to-one,one-to-many,many-to-one,many-to-many forbid - target-to-source any any
research:entails one-to-one,one-to-many,many-to-one,many-to-many forbid transitive source-to-target any any
research:predicts one-to-one,one-to-many,many-to-many forbid - source-to-target any any
research:measured_by one-to-one,one-to-many,many-to-one,many-to-many forbid - target-to-source any any
research:tests one-to-one,one-to-many,many-to-many forbid - source-to-target any any
research:supports one-to-one,one-to-many,many-to-one,many-to-many forbid - source-to-target any any
research:contradicts one-to-one,one-to-many,many-to-one,many-to-many forbid - source-to-target any any
research:competes_with one-to-one,many-to-many allow symmetric both any any
research:valid_under one-to-one,one-to-many,many-to-one,many-to-many forbid - target-to-source any any
research:recovers one-to-one,one-to-many,many-to-many forbid - target-to-source any any
research:refines one-to-one,many-to-one,many-to-many forbid transitive target-to-source any any
"""


@dataclass(frozen=True)
class Relation:
    id: str
    cardinalities: tuple[str, ...] | None = None
    cycle_policy: str = "allow"
    transitive: bool = False
    symmetric: bool = False
    impact_direction: str | None = None
    source_kinds: tuple[str, ...] | None = None
    target_kinds: tuple[str, ...] | None = None
    inverse: str | None = None
    composes_with: tuple[str, ...] = field(default=())


def builtin_packs() -> dict[str, list[Relation]]:
    """The built-in packs by name: core, routing, topology, research."""
    packs: dict[str, list[Relation]] = {}
    for line in VOCABULARY.split("\n"):
        if not line.strip():
            continue
        name, cardinalities, cycles, flag, impact, sources, targets = line.split()
        kinds = lambda text: None if text == "any" else tuple(text.split(","))
        packs.setdefault(name.split(":")[0], []).append(
            Relation(name, tuple(cardinalities.split(",")), cycles, flag == "transitive", flag == "symmetric", impact, kinds(sources), kinds(targets))
        )
    return packs


def parse_pack(value: dict) -> tuple[str, str, list[Relation]]:
    """(id, version, relations) of a pack document; malformed ones raise."""
    if not isinstance(value, dict) or not all(isinstance(value.get(k), str) and value[k] for k in ("id", "version")) or not isinstance(value.get("relations"), list):
        raise ValueError("relation pack: id, version and relations are required")
    known = {"id", "description", "sourceKinds", "targetKinds", "cardinalities", "cyclePolicy", "transitive", "symmetric", "inverse", "composesWith", "impactDirection"}
    relations = []
    for r in value["relations"]:
        if not isinstance(r, dict) or not is_relation_identifier(r.get("id")) or r.get("cyclePolicy") not in ("allow", "forbid") or set(r) - known:
            raise ValueError(f"relation pack {value['id']}: malformed relation {r!r}")
        if set(r.get("cardinalities", ())) - set(CARDINALITIES) or r.get("impactDirection", "both") not in DIRECTIONS:
            raise ValueError(f"relation pack {value['id']}: malformed relation {r['id']}")
        many = lambda k, r=r: tuple(r[k]) if k in r else None
        relations.append(Relation(r["id"], many("cardinalities"), r["cyclePolicy"], r.get("transitive", False), r.get("symmetric", False), r.get("impactDirection"), many("sourceKinds"), many("targetKinds"), r.get("inverse"), tuple(r.get("composesWith", ()))))
    return value["id"], value["version"], relations


class RelationRegistry:
    """Relations by id. The core pack is always there; a pack may be registered again only unchanged."""

    def __init__(self, packs=("core",)):
        self.relations: dict[str, Relation] = {}
        self.packs: dict[tuple[str, str], str] = {}
        built = builtin_packs()
        for name in dict.fromkeys(("core", *packs)):
            self.register(f"urn:corrgraph:relation-pack:{name}", "1.0.0", built[name])

    def register(self, pack: str, version: str, relations: list[Relation]) -> None:
        text = json.dumps([asdict(r) for r in relations])
        if (pack, version) in self.packs:
            if self.packs[pack, version] != text:
                raise ValueError(f"relation pack {pack}@{version} is registered with other content")
            return
        for r in relations:
            if r.id in self.relations:
                raise ValueError(f"relation {r.id} is registered already")
        self.packs[pack, version] = text
        self.relations |= {r.id: r for r in relations}

    def get(self, relation: str) -> Relation | None:
        return self.relations.get(relation)

    def has_pack(self, pack: str, version: str) -> bool:
        return (pack, version) in self.packs

    def all(self) -> list[Relation]:
        return [self.relations[k] for k in sorted(self.relations)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per relation: a dimension of as many rows as the packs declare."""
        rows = [(r.id, list(r.cardinalities) if r.cardinalities else None, r.cycle_policy, r.symmetric, r.impact_direction, list(r.source_kinds) if r.source_kinds else None, list(r.target_kinds) if r.target_kinds else None) for r in self.all()]
        return spark.createDataFrame(rows, "relation string, cardinalities array<string>, cycle_policy string, symmetric boolean, impact_direction string, source_kinds array<string>, target_kinds array<string>")


def all_packs() -> RelationRegistry:
    return RelationRegistry(("core", "routing", "topology", "research"))
