"""Chat requests in the shapes of three providers, and structured documents as Markdown: plain data in, plain data out."""

from __future__ import annotations

import json


def provider_request(messages: list[dict], tools: list[dict], scheme: str = "openai", model: str = "", temperature: float = 0.0) -> dict:
    """A request body. Canonical messages have role, content, tool_calls and tool_call_id; tools name, description and parameters."""
    system = " ".join(m["content"] for m in messages if m["role"] == "system" and m.get("content"))
    rest = [m for m in messages if m["role"] != "system"]
    if scheme == "anthropic":
        out = []
        for m in rest:
            if m["role"] == "tool":
                out.append({"role": "user", "content": [{"type": "tool_result", "tool_use_id": m.get("tool_call_id"), "content": m.get("content")}]})
            else:
                parts = [{"type": "text", "text": m["content"]}] if m.get("content") else []
                parts += [{"type": "tool_use", "id": c.get("id"), "name": c["function"]["name"], "input": _args(c)} for c in m.get("tool_calls") or []]
                out.append({"role": m["role"], "content": parts})
        return {"model": model, "system": system, "messages": out, "temperature": temperature, "tools": [{"name": t["name"], "description": t.get("description", ""), "input_schema": t.get("parameters", {})} for t in tools]}
    if scheme == "google":
        out = []
        for m in rest:
            if m["role"] == "tool":
                out.append({"role": "user", "parts": [{"functionResponse": {"name": m.get("tool_call_id"), "response": {"content": m.get("content")}}}]})
            else:
                parts = [{"text": m["content"]}] if m.get("content") else []
                parts += [{"functionCall": {"name": c["function"]["name"], "args": _args(c)}} for c in m.get("tool_calls") or []]
                out.append({"role": "model" if m["role"] == "assistant" else m["role"], "parts": parts})
        return {"contents": out, "systemInstruction": {"parts": [{"text": system}]}, "tools": [{"function_declarations": tools}] if tools else [], "generationConfig": {"temperature": temperature}}
    return {"model": model, "messages": messages, "temperature": temperature, "tools": [{"type": "function", "function": t} for t in tools]}


def _args(call: dict) -> dict:
    a = call["function"].get("arguments") or {}
    return json.loads(a) if isinstance(a, str) else a


def document_markdown(doc: dict) -> str:
    """Markdown of a structured document: headings, bold, italic, links, bullets, tables."""

    def runs(p: dict) -> str:
        out = []
        for e in p.get("elements", []):
            r = e.get("textRun") or {}
            t, s = r.get("content", ""), r.get("textStyle", {})
            body = t.strip("\n")
            if body.strip():
                if s.get("bold"):
                    body = f"**{body}**"
                if s.get("italic"):
                    body = f"*{body}*"
                if url := (s.get("link") or {}).get("url"):
                    body = f"[{body}]({url})"
            out.append(body)
        return "".join(out)

    def block(items: list[dict]) -> list[str]:
        lines = []
        for it in items:
            if "paragraph" in it:
                p = it["paragraph"]
                style = p.get("paragraphStyle", {}).get("namedStyleType", "")
                head = "#" * int(style[-1]) + " " if style.startswith("HEADING_") else "# " if style == "TITLE" else ""
                nest = p.get("bullet", {}).get("nestingLevel", 0) if "bullet" in p else None
                text = runs(p)
                if text.strip():
                    lines.append(head + ("  " * nest + "- " if nest is not None else "") + text)
            elif "table" in it:
                for i, row in enumerate(it["table"].get("tableRows", [])):
                    cells = [" ".join(block(c.get("content", []))) for c in row.get("tableCells", [])]
                    lines.append("| " + " | ".join(cells) + " |")
                    if i == 0:
                        lines.append("|" + " --- |" * len(cells))
        return lines

    return "\n\n".join(block(doc.get("body", {}).get("content", [])))
