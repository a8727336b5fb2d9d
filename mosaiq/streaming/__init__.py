"""mosaiq.streaming"""
