"""sleuthframe.functions"""
