"""mosaiq.sources"""
