"""The service's operations as plain functions over a store: (status code, body). A web server only has to route to them."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import client, graph, search
from .sources import files, pipeline
from .sources.store import Store

UPLOAD_BYTES = 20 * 1024 * 1024
ACCEPTED = (*files.PDF, *files.SCANS, *files.TEXT)
FIELDS = ("filename", "title", "content", "file_path", "file_type", "metadata")
Reply = tuple[int, dict]


def _wrong(message: str, code: int = 400) -> Reply:
    return code, {"success": False, "error": message}


def _decoded(row) -> dict:
    """A stored row with its metadata as an object; what can't be read is an empty one."""
    out = row.asDict()
    try:
        meta = json.loads(out.get("metadata") or "{}")
    except ValueError:
        meta = {}
    out["metadata"] = meta if isinstance(meta, dict) else {}
    out["created_at"] = None if out.get("created_at") is None else out["created_at"].isoformat(sep="T", timespec="seconds")
    return out


def documents(store: Store, limit: int | None = 50) -> Reply:
    """The newest documents: 50 if the limit is below 1, 500 at most."""
    rows = [_decoded(r) for r in store.newest("documents", limit=search.clamp(limit, 50, 500)).collect()]
    return 200, {"success": True, "count": len(rows), "documents": rows}


def document(store: Store, doc_id: int) -> Reply:
    row = store.document(doc_id).first()
    return _wrong("Document not found.", 404) if row is None else (200, {"success": True, "document": _decoded(row)})


def create(store: Store, data) -> Reply:
    """A document from a JSON object: a filename it must have; metadata that aren't an object are left out."""
    if not isinstance(data, dict):
        return _wrong("Request body must contain valid JSON.")
    values = {k: str(data.get(k, "")) for k in FIELDS[:-1]}
    values |= {k: values[k].strip() for k in ("filename", "title")}
    if not values["filename"]:
        return _wrong("filename is required.")
    meta = data.get("metadata", {})
    row = store.spark.createDataFrame([(*values.values(), json.dumps(meta if isinstance(meta, dict) else {}))], ", ".join(f"{k} string" for k in FIELDS))
    return 201, {"success": True, "message": "Document created successfully.", "document_id": store.append("documents", row).first()["id"]}


def update(store: Store, doc_id: int, data) -> Reply:
    if not isinstance(data, dict):
        return _wrong("Request body must contain valid JSON.")
    values = {k: data[k] for k in FIELDS if k in data}
    if "filename" in values:
        values["filename"] = str(values["filename"]).strip()
        if not values["filename"]:
            return _wrong("filename cannot be empty.")
    if "metadata" in values:
        if not isinstance(values["metadata"], dict):
            return _wrong("metadata must be a JSON object.")
        values["metadata"] = json.dumps(values["metadata"])
    if not values:
        return _wrong("No valid fields provided for update.")
    if not store.update_document(doc_id, **values):
        return _wrong("Document not found.", 404)
    return 200, {"success": True, "message": "Document updated successfully.", "document_id": doc_id}


def delete(store: Store, doc_id: int) -> Reply:
    if not store.delete_document(doc_id):
        return _wrong("Document not found.", 404)
    return 200, {"success": True, "message": "Document deleted successfully.", "document_id": doc_id}


def find(store: Store, query: str | None, limit: int | None = 20) -> Reply:
    """Search results with a preview in place of the content."""
    query = (query or "").strip()
    if not query:
        return _wrong("Search query 'q' is required.")
    rows = search.shown(search.search_documents(store.read("documents"), query, limit)).drop("content", "metadata").collect()
    return 200, {"success": True, "query": query, "count": len(rows), "results": [r.asDict() for r in rows]}


def validate_query(data) -> str | None:
    """What is wrong with a query's body, None if nothing is."""
    if not isinstance(data, dict):
        return "Request body must contain valid JSON."
    query = data.get("query")
    if not query:
        return "Query is required."
    if not isinstance(query, str):
        return "Query must be a string."
    return None if query.strip() else "Query cannot be empty."


def _rows(df: DataFrame | None) -> list[dict]:
    return [] if df is None else [r.asDict() for r in df.collect()]


def query(store: Store, data) -> Reply:
    """What is known around a query, 1 to 20 of each kind (5 where the number can't be read)."""
    if wrong := validate_query(data):
        return _wrong(wrong)
    asked = data["query"].strip()
    try:
        k = max(1, min(int(data.get("top_k", 5)), 20))
    except (TypeError, ValueError):
        k = 5
    found = search.retrieve({t: store.read(t) for t in ("documents", "entities", "relationships", "decisions", "sources")}, asked, k)
    context = found.pop("graph_context")
    body = {n: _rows(found[n]) for n in ("documents", "entities", "relationships", "decisions", "sources")}
    known = any(body[n] for n in ("documents", "entities", "decisions", "relationships"))
    body["graph_context"] = {"stats": next(iter(_rows(context["stats"])), {}), "entity": context["entity"], "related_entities": _rows(context["related_entities"])}
    said = "Relevant information retrieved successfully." if known else "Information was not found."
    return 200, {"success": True, "query": asked, "top_k": k, "message": "Query processed successfully.", **body, "context": search.context_text(found), "answer": said}


def topology(store: Store) -> Reply:
    """The graph of the stored entities and relationships."""
    out = graph.exported(*graph.named_graph(store.read("entities"), store.read("relationships")))
    links = _rows(out["links"])
    return 200, {"nodes": _rows(out["nodes"]), "edges": links, "links": links, "stats": _rows(out["stats"])[0]}


def notifications(store: Store) -> Reply:
    return 200, {"notifications": _rows(client.notifications(store.read("documents")))}


def profile(name: str = "", role: str = "", email: str = "", organization: str = "", clearance: str = "") -> Reply:
    """Who the service is set up for."""
    return 200, {"name": name, "role": role, "email": email, "organization": organization, "clearance": clearance}


def health(store: Store) -> Reply:
    return 200, {"success": True, "status": "healthy", "database": "connected" if store.read("documents") is not None else "missing", "knowledge_graph": "initialized"}


def part_health(part: str) -> Reply:
    """Of the search or the query service."""
    return 200, {"success": True, "service": part, "status": "healthy"}


class Jobs:
    """The states of intakes by id; readers get copies."""

    def __init__(self):
        self._all: dict[str, dict] = {}
        self._lock = threading.Lock()

    def put(self, job: str, **values) -> None:
        with self._lock:
            self._all.setdefault(job, {}).update(values)

    def get(self, job: str) -> dict | None:
        with self._lock:
            return dict(self._all[job]) if job in self._all else None

    def status(self, job: str) -> Reply:
        own = self.get(job)
        return _wrong("Processing job not found.", 404) if own is None else (200, {"success": True, **own})


def upload(store: Store, jobs: Jobs, filename: str, content: bytes, extract: Callable, inline: bool = False) -> Reply:
    """Accepts a text file and takes it in behind the scenes (``inline``: at once); the job's state tells how far it is."""
    name = (filename or "").replace("\\", "/").rsplit("/", 1)[-1]
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if not name:
        return _wrong("No file uploaded.")
    if kind not in ACCEPTED:
        return _wrong("Supported files: PDF, PNG, JPG, JPEG, TXT and MD")
    if len(content) > UPLOAD_BYTES:
        return _wrong("The file is too large.", 413)
    job = uuid.uuid4().hex
    jobs.put(job, fileName=name, progress=10, stage="Initiating document upload...", isComplete=False, status="processing")

    def work() -> None:
        try:
            jobs.put(job, progress=20, stage="Step 1 of 3: Extracting Text & Metadata...")
            raw = store.spark.createDataFrame([(job, name, f"{job}.{kind}", bytearray(content))], "document_id string, filename string, path string, content binary")
            body = F.when(F.lit(kind in files.TEXT), files.decoded(F.col("content")))
            jobs.put(job, progress=55, stage="Step 2 of 3: Building Knowledge Graph Entities...")
            row = pipeline.intake(store, raw.select("document_id", "filename", "path", body.alias("text")), extract).first()
            if row["error"]:
                raise ValueError(row["error"])
            jobs.put(job, documentId=row["id"], progress=100, stage="Step 3 of 3: Knowledge Graph Indexing Complete!", isComplete=True, status="complete")
        except Exception as e:  # the job's state is where a caller looks
            jobs.put(job, progress=100, stage=f"Processing failed: {e}", isComplete=True, status="failed", error=str(e))

    if inline:
        work()
    else:
        threading.Thread(target=work, daemon=True).start()
    return 202, {"success": True, "documentId": job, "status": "processing", "fileName": name}


def guarded(operation: Callable[..., Reply], *args) -> Reply:
    """The operation's reply, or what went wrong as one."""
    try:
        return operation(*args)
    except Exception as e:
        return 500, {"success": False, "error": "The operation failed.", "details": str(e)}
