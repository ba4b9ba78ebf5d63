from replaylab.sources.plays import event_plays, plays

__all__ = ["plays", "event_plays"]
