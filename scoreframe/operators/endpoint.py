"""A function for `generate` that asks a chat-completion endpoint."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from typing import Any


def response_text(raw: str | bytes) -> str:
    """The answer in a chat-completion response document.

    Raises ValueError where there is no first choice, or it is no object, its message is
    none, its content is no text, or `raw` is not one JSON document. A missing message or
    content, and a null content, is the empty string.
    """
    try:
        document = json.loads(raw)
        content = document["choices"][0].get("message", {}).get("content")
    except (ValueError, TypeError, LookupError, AttributeError, RecursionError) as problem:
        raise ValueError("unexpected response") from problem
    if content is not None and not isinstance(content, str):
        raise ValueError("unexpected response")
    return content or ""


def chat_completion(
    api_url: str,
    model: str,
    temperature: float = 0.7,
    max_tokens: int = 500,
    timeout: float = 60.0,
    **extra: Any,
) -> Callable[[str], str]:
    """`prompt -> text` over HTTP; the same body and answer as the request and response tables.

    Any status but success, and an answer without choices, raises, so that `generate`
    tries again. A choice without content is the empty string.
    """

    def answer(prompt: str) -> str:
        body = {
            **extra,
            "model": model,
            "messages": [{"role": "user", "content": prompt}],
            "temperature": temperature,
            "max_tokens": max_tokens,
        }
        request = urllib.request.Request(
            api_url, json.dumps(body).encode(), {"Content-Type": "application/json"}
        )
        with urllib.request.urlopen(request, timeout=timeout) as response:
            if response.status != 200:
                raise ConnectionError(f"status {response.status}")
            return response_text(response.read())

    return answer
