"""What the operators share with the rest of the engine."""

from ..session import free_name, qualified, scratch, shared_root, ship, stored

__all__ = ["free_name", "qualified", "scratch", "shared_root", "ship", "stored"]
