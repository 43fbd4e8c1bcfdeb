"""Progress channels: what jobs and pipelines tell while they run."""

from __future__ import annotations

import queue


class EventBus:
    """Events to every subscriber; one that lags behind loses its oldest."""

    def __init__(self, size: int = 256) -> None:
        self.size, self.queues = size, []

    def subscribe(self) -> queue.Queue:
        q: queue.Queue = queue.Queue(self.size)
        self.queues.append(q)
        return q

    def publish(self, event: dict) -> None:
        for q in self.queues:
            while True:
                try:
                    q.put_nowait(event)
                    break
                except queue.Full:
                    try:
                        q.get_nowait()
                    except queue.Empty:
                        pass
