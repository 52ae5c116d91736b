"""tessella.sources"""
