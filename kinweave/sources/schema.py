"""The network's relations: their columns, files and the record that holds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: Relation -> (file, ((column, type, position in the file), ...)); other positions are ignored.
FILES = {
    "person": ("person.csv", (("id", "long", 0), ("birthday", "date", 4))),
    "knows": ("person_knows_person.csv", (("src", "long", 0), ("dst", "long", 1))),
    "comment_creator": ("comment_hasCreator_person.csv", (("comment_id", "long", 0), ("person_id", "long", 1))),
    "reply_of": ("comment_replyOf_comment.csv", (("comment_id", "long", 0), ("parent_id", "long", 1))),
    "place": ("place.csv", (("id", "long", 0), ("name", "string", 1))),
    "place_part_of": ("place_isPartOf_place.csv", (("child", "long", 0), ("parent", "long", 1))),
    "located": ("person_isLocatedIn_place.csv", (("person_id", "long", 0), ("place_id", "long", 1))),
    "org_place": ("organisation_isLocatedIn_place.csv", (("org_id", "long", 0), ("place_id", "long", 1))),
    "study_at": ("person_studyAt_organisation.csv", (("person_id", "long", 0), ("org_id", "long", 1))),
    "work_at": ("person_workAt_organisation.csv", (("person_id", "long", 0), ("org_id", "long", 1))),
    "tag": ("tag.csv", (("id", "long", 0), ("name", "string", 1))),
    "interest": ("person_hasInterest_tag.csv", (("person_id", "long", 0), ("tag_id", "long", 1))),
    "forum_tag": ("forum_hasTag_tag.csv", (("forum_id", "long", 0), ("tag_id", "long", 1))),
    "forum_member": ("forum_hasMember_person.csv", (("forum_id", "long", 0), ("person_id", "long", 1))),
}


class Network:
    """A social network: one DataFrame attribute for each relation of :data:`FILES`.

    A relation may be given as a function, which is called when the relation is first used.
    """

    def __init__(self, **relations: DataFrame | Callable[[], DataFrame]):
        if missing := set(FILES) ^ set(relations):
            raise ValueError(f"missing or unknown relations: {', '.join(sorted(missing))}")
        self._relations = relations

    def __getattr__(self, name: str) -> DataFrame:
        relations = self.__dict__.get("_relations", {})
        if name not in relations:
            raise AttributeError(name)
        if not isinstance(relations[name], DataFrame):
            relations[name] = relations[name]()
        return relations[name]

    def but(self, **relations: DataFrame | Callable[[], DataFrame]) -> Network:
        """The same network with other relations of these names."""
        return Network(**(self._relations | relations))

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in FILES}
