"""Records as nested JSON of public vocabularies; every function returns a string column.

Members that are null are left out.  Times are arguments: a column of the record,
never the clock.  ``BY`` names the maker where a format asks for one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BY = "Colophon"
#: Contexts and types of the vocabularies.
PROV, ANNO, CIDOC, CRATE = "http://www.w3.org/ns/prov.jsonld", "http://www.w3.org/ns/anno.jsonld", "https://cidoc-crm.org/7.1.1/", "https://w3id.org/ro/crate/1.1"
DATACITE = "https://datacite.org/schema/schema-4.6.mds"
#: Selectors of a text anchor: a position (start, end) or a quote (exact, prefix, suffix).
SELECTORS = "array<struct<type:string,start:bigint,end:bigint,exact:string,prefix:string,suffix:string>>"


def _s(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _object(**members) -> Column:
    """A struct of the members; a double underscore stands for a colon, a leading one for an at sign."""
    name = lambda k: ("@" + k[1:] if k.startswith("_") else k).replace("__", ":")
    return F.struct(*[_s(v).alias(name(k)) for k, v in members.items()])


def _list(items: Column) -> Column:
    """JSON texts as one JSON array."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


# --- provenance ----------------------------------------------------------------


def prov_activity(activity_id: Column, used: Column, generated: Column, started: Column, ended: Column, actor: Column | None = None, software: Column | None = None, version: Column | None = None) -> Column:
    """``used`` and ``generated`` are arrays of ids; software is one more thing used."""
    entity = lambda x, kind, by: F.struct(F.lit(kind).alias("type"), x.alias("id"), by.alias("prov:wasAttributedTo"))
    none = F.lit(None).cast("string")
    things = lambda xs: F.transform(xs, lambda x: entity(x, "prov:Entity", none))
    all_used = things(used)
    if software is not None:
        all_used = F.concat(all_used, F.array(entity(software, "prov:SoftwareAgent", none if version is None else version)))
    some = lambda xs: F.when(F.size(xs) > 0, xs)
    agent = none if actor is None else F.when(actor != "", F.struct(F.lit("prov:Agent").alias("type"), actor.alias("id")))
    return F.to_json(_object(_context=PROV, type="prov:Activity", id=activity_id, prov__startedAtTime=started, prov__endedAtTime=ended, prov__used=some(all_used), prov__generated=some(things(generated)), prov__wasAssociatedWith=agent))


def prov_entity(entity_id: Column, kind: str = "prov:Entity") -> Column:
    return F.to_json(_object(_context=PROV, type=kind, id=entity_id))


def prov_agent(agent_id: Column, kind: str = "prov:Agent") -> Column:
    return prov_entity(agent_id, kind)


def prov_graph(entities: Column, activities: Column, agents: Column) -> Column:
    """A bundle of arrays of the JSON texts above."""
    return F.concat(F.lit(f'{{"@context":"{PROV}","type":"prov:Bundle","entities":'), _list(entities), F.lit(',"activities":'), _list(activities), F.lit(',"agents":'), _list(agents), F.lit("}"))


# --- annotations ---------------------------------------------------------------


def anchor_selectors(start: Column, end: Column, exact: Column) -> Column:
    """The two selectors of a passage."""
    none, long = F.lit(None).cast("string"), lambda c: c.cast("bigint")
    position = F.struct(F.lit("TextPosition").alias("type"), long(start).alias("start"), long(end).alias("end"), none.alias("exact"), none.alias("prefix"), none.alias("suffix"))
    quote = F.struct(F.lit("TextQuote").alias("type"), long(F.lit(None)).alias("start"), long(F.lit(None)).alias("end"), exact.alias("exact"), none.alias("prefix"), none.alias("suffix"))
    return F.array(position, quote).cast(SELECTORS)


def web_annotation(source: Column, selectors: Column, body: Column, created: Column) -> Column:
    """The first selector is the target; without any, the whole source."""
    first = F.to_json(F.get(selectors, F.lit(0)))
    whole = F.to_json(_object(type="TextPositionSelector", source=source))
    head = F.to_json(_object(_context=ANNO, type="Annotation", body=_object(type="TextualBody", value=body)))
    return F.concat(F.expr("''"), F.regexp_replace(head, r"\}$", ""), F.lit(',"target":'), F.when(F.size(selectors) > 0, first).otherwise(whole), F.lit(',"created":"'), created, F.lit(f'","generator":"{BY}"}}'))


def annotation_collection(annotations: Column) -> Column:
    return F.concat(F.lit(f'{{"@context":"{ANNO}","type":"AnnotationCollection","items":'), _list(annotations), F.lit("}"))


def web_from_annotation(annotation_id: Column, source: Column, start: Column, end: Column, value: Column, motivation: Column, created: Column, media: str = "text/plain") -> Column:
    selector = _object(type="TextPositionSelector", start=start, end=end)
    return F.to_json(_object(_context="http://www.w3.org/ns/anno/jsonld", type="Annotation", id=annotation_id, target=_object(source=source, selector=selector), body=_object(type="TextualBody", value=value, format=media), motivation=motivation, created=created))


def atlas_from_annotation(label: Column, lemma: Column, morph_code: Column, parsing: Column) -> Column:
    return F.to_json(_object(label=F.coalesce(label, F.lit("")), lemma=F.coalesce(lemma, F.lit("")), morphCode=F.coalesce(morph_code, F.lit("")), parsing=F.coalesce(parsing, F.lit(""))))


def passage_annotation(work_id: Column, passage_id: Column, text: Column, annotations: Column, created: Column) -> Column:
    head = F.to_json(_object(work_id=work_id, passage_id=passage_id, text=text))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"annotations":'), _list(annotations), F.lit(',"metadata":{"created_at":"'), created, F.lit(f'","source":"{BY}"}}}}'))


def stam_from_anchor(annotation_id: Column, source: Column, selectors: Column, created: Column) -> Column:
    """Of several selectors the last one is the target."""
    last = F.try_element_at(selectors, F.lit(-1))
    position = last["type"] == "TextPosition"
    target = F.when(last["type"].isin("TextPosition", "TextQuote"), _object(type="TextSelector", text=_object(set=source), begin=F.when(position, F.coalesce(last["start"], F.lit(0))), end=F.when(position, F.coalesce(last["end"], F.lit(0))), quote=F.when(~position, F.coalesce(last["exact"], F.lit("")))))
    return F.to_json(_object(type="Annotation", id=annotation_id, target=target, body=_object(type="TextualBody", value=""), motivation="linking", created=created))


def anchor_from_stam(annotation: Column) -> Column:
    """Struct of id, source and selectors of a stand-off annotation."""
    a = F.from_json(annotation, "id string, target struct<type:string,text:struct<set:string>,begin:bigint,end:bigint,quote:string>")
    none, t = F.lit(None).cast("string"), a["target"]
    position = F.when((t["type"] == "TextSelector") & t["begin"].isNotNull() & t["end"].isNotNull(), F.struct(F.lit("TextPosition").alias("type"), t["begin"].alias("start"), t["end"].alias("end"), none.alias("exact"), none.alias("prefix"), none.alias("suffix")))
    quote = F.when((t["type"] == "TextSelector") & t["quote"].isNotNull(), F.struct(F.lit("TextQuote").alias("type"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"), t["quote"].alias("exact"), none.alias("prefix"), none.alias("suffix")))
    return F.struct(a["id"].alias("id"), F.coalesce(t["text"]["set"], F.lit("")).alias("source"), F.array_compact(F.array(position, quote)).cast(SELECTORS).alias("selectors"))


def stam_set(set_id: Column, name: Column, annotations: Column, created: Column) -> Column:
    head = F.to_json(_object(type="AnnotationSet", id=set_id, name=name))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"annotations":'), _list(annotations), F.lit(',"created":"'), created, F.lit('"}'))


# --- citation, heritage, packages ------------------------------------------------


def datacite(identifier: Column, title: Column, creators: Column, description: Column, year: Column, newer_than: Column | None = None) -> Column:
    """``creators``: array of names; ``newer_than``: DOIs of earlier versions."""
    person = lambda c: F.struct(c.alias("name"), F.lit("Personal").alias("nameType"))
    version = lambda d: F.struct(d.alias("relatedIdentifier"), F.lit("DOI").alias("relatedIdentifierType"), F.lit("IsNewVersionOf").alias("relationType"), F.lit("Dataset").alias("resourceTypeGeneral"))
    related = None if newer_than is None else F.when(F.size(newer_than) > 0, F.transform(F.filter(newer_than, lambda d: d != ""), version))
    attributes = dict(
        identifiers=F.array(_object(identifier=identifier, identifierType="Handle")), titles=F.array(_object(title=title)), creators=F.transform(creators, person), descriptions=F.array(_object(description=description, descriptionType="Abstract")),
        publisher=BY, publicationYear=year, types=_object(resourceTypeGeneral="Dataset", resourceType="Scholarly Database"), schemaVersion=DATACITE,
    )
    if related is not None:
        attributes["relatedIdentifiers"] = related
    return F.to_json(_object(data=_object(type="dois", attributes=_object(**attributes))))


def datacite_snapshot(snapshot_id: Column, created_at: Column, cursor: Column, year: Column) -> Column:
    return datacite(snapshot_id, F.concat(F.lit(f"{BY} Snapshot "), F.substring(created_at, 1, 10)), F.array(F.lit(f"{BY} Project")), F.concat(F.lit("Snapshot at event cursor "), cursor.cast("string")), year)


def cidoc_work(work_id: Column, title: Column, authors: Column) -> Column:
    actors = F.transform(authors, lambda a: F.struct(F.lit("crm:E39_Actor").alias("type"), a.alias("crm:P102_has_title")))
    return F.to_json(_object(_context=CIDOC, type="crm:E31_Documentary_Object", id=work_id, crm__P102_has_title=title, crm__P106_is_composed_of=actors))


def _within(at: Column) -> Column:
    return _object(crm__P82_at_some_time_within=at)


def cidoc_activity(activity_id: Column, kind: Column, started: Column) -> Column:
    return F.to_json(_object(_context=CIDOC, type="crm:E5_Event", id=activity_id, crm__P1_has_type=kind, crm__P4_has_time_span=_within(started)))


def cidoc_observation(observation_id: Column, provider: Column, observed: Column) -> Column:
    return F.to_json(_object(_context=CIDOC, type="crmsci:O2_Observation", id=observation_id, crm__P10_was_used_by=provider, crm__P4_has_time_span=_within(observed)))


def ro_crate(work_id: Column, title: Column, files: Column, published: Column, licence: str = "https://creativecommons.org/licenses/by-sa/4.0/") -> Column:
    """Metadata of a package: the data set, the descriptor, and each of ``files`` (an array of paths)."""
    about = _object(_id=work_id)
    data_set = F.to_json(_object(_type="Dataset", _id=work_id, name=title, description=F.concat(F.lit("Scholarly record for "), title), license=licence, creator=_object(_type="Organization", name=BY), datePublished=published))
    descriptor = F.to_json(_object(_type="CreativeWork", _id="ro-crate-metadata.json", conformsTo=CRATE, about=about))
    parts = F.transform(files, lambda f: F.to_json(F.struct(F.lit("File").alias("@type"), F.concat(F.lit("file://"), f).alias("@id"), F.substring_index(f, "/", -1).alias("name"), F.struct(work_id.alias("@id")).alias("about"))))
    return F.concat(F.lit(f'{{"@context":"{CRATE}/context","@graph":'), _list(F.concat(F.array(data_set, descriptor), parts)), F.lit("}"))


def c2pa_manifest(title: Column, digest: Column, generator: str) -> Column:
    hash_ = F.struct(F.lit("c2pa.hash.data").alias("label"), F.struct(F.lit("sha256").alias("alg"), digest.alias("hash")).alias("data"))
    return F.to_json(F.struct(F.lit(generator).alias("claim_generator"), title.alias("title"), F.array(hash_).alias("assertions")))


def dataset_card(title: Column, description: Column, n_rows: Column, licence: str = "cc-by-sa-4.0", languages: tuple[str, ...] = ("sa", "en"), tags: tuple[str, ...] = ()) -> Column:
    """Front matter, title, description and size of a data set's page."""
    lines = lambda key, xs: f"{key}:\n" + "".join(f"  - {x}\n" for x in xs) if xs else ""
    return F.concat(F.lit(f"---\n{lines('language', languages)}license: {licence}\n{lines('tags', tags)}---\n\n# "), title, F.lit("\n\n"), description, F.lit("\n\nRows: "), n_rows.cast("string"), F.lit("\n"))


# --- answers ---------------------------------------------------------------------


def envelope(results: Column, count: Column) -> Column:
    return F.to_json(F.struct(F.struct(count.alias("count")).alias("meta"), results.alias("results")))


def error(code: Column, message: Column, status: Column) -> Column:
    return F.to_json(_object(error=_object(code=code, message=message, status=status)))


# --- a model's verdict -------------------------------------------------------------

VERDICT = "fits_work string, tier string, language string, reason string"


def judged(answer: Column) -> Column:
    """The first JSON object in a model's answer as a verdict; without a readable one, an undecided verdict that says why."""
    found = F.from_json(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0), VERDICT)
    closed = F.struct(F.lit("unknown").alias("fits_work"), F.lit("uncertain").alias("tier"), F.lit("uncertain").alias("language"), F.concat(F.lit("__PARSE__ "), F.substring(F.coalesce(answer, F.lit("")), 1, 60)).alias("reason"))
    return F.when(F.coalesce(found["fits_work"], found["tier"], found["language"], found["reason"]).isNotNull(), found).otherwise(closed)
