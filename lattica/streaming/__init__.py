"""Streams of frames, poses and questions."""
